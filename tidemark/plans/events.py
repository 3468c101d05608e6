"""Event analytics: event study, adverse selection, lead-lag, overlap, clusters, pressure, offsets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scalar as S
from tidemark.functions import stats
from tidemark.operators import sessions
from tidemark.operators.timeline import Request, evaluate
from tidemark.schema import SECOND
from tidemark.sources.events import Market


def found_clusters(m: Market) -> DataFrame:
    return sessions.clusters(m.events(), m.params.gap_us)


def found_cascades(m: Market) -> DataFrame:
    p = m.params
    return sessions.cascades(found_clusters(m), p.cascade_n, p.cascade_notional, p.cascade_s)


def cluster_rates(m: Market) -> DataFrame:
    p = m.params
    d = found_clusters(m).withColumn("split", S.split_label("t0", p.split_us))
    days = F.when(F.col("split") == "train", F.lit(float(p.train_days))).otherwise(F.lit(float(p.val_days)))
    return d.groupBy("sym", "split").agg(
        F.count(F.lit(1)).alias("clusters"), F.count_if((F.col("n") >= p.cascade_n) & (F.col("notional") >= p.cascade_notional) & (F.col("dur_s") <= p.cascade_s)).alias("cascades"),
        (100.0 * F.count_if("multi_ex") / F.count(F.lit(1))).alias("multi_ex_pct"), F.max("n").alias("size_max"), F.percentile("n", 0.99).alias("size_p99"), (F.count(F.lit(1)) / F.max(days)).alias("per_day"),
    )


def cluster_sizes(m: Market) -> DataFrame:
    return found_clusters(m).groupBy("sym", F.col("n").alias("size")).agg(F.count(F.lit(1)).alias("clusters"))


def cluster_survival(m: Market) -> DataFrame:
    return stats.ecdf(found_clusters(m).select("sym", "notional"), "notional", ["sym"], survival=True)


def overlap_shares(m: Market) -> DataFrame:
    d = sessions.near_other(m.events(), m.params.near_us).withColumn("split", S.split_label("t", m.params.split_us))
    return d.groupBy("sym", F.col("stream").alias("anchor"), "split").agg(F.count(F.lit(1)).alias("events"), F.round(100.0 * F.count_if("near") / F.count(F.lit(1)), 1).alias("near_pct"))


def event_moves(m: Market) -> DataFrame:
    """Each event with its cluster's notional, size and venues, and signed forward moves in bps."""
    p = m.params
    w = Window.partitionBy("sym", "cid")
    ev = sessions.with_cluster(m.events(), p.gap_us)
    ev = ev.withColumns({"cnotl": F.sum("notional").over(w), "csize": F.count(F.lit(1)).over(w), "n1": F.count_if(F.col("stream") == "liq_exchange_1").over(w), "n2": F.count_if(F.col("stream") == "liq_exchange_2").over(w), "s": S.side_sign("side")})
    q = ev.select("sym", "t", "row_id", F.col("stream").alias("venue"), "cnotl", "csize", "n1", "n2", "s")
    at = {h: Request("asof", "", "mid", hi=h * SECOND, beyond_null=True) for h in (0, *p.study_s)}
    d = evaluate(q, m.events().limit(0), m.quotes(), at.values(), bucket_us=p.bucket_us)
    moves = [(F.col("s") * S.bps(at[h].column, at[0].column)).alias(f"signed_{h}s") for h in p.study_s]
    member = F.when((F.col("n1") > 0) & (F.col("n2") > 0), "both").when(F.col("n2") > 0, "exchange_2_only").otherwise("exchange_1_only")
    return d.select("sym", "t", "row_id", "venue", "cnotl", "csize", member.alias("membership"), S.split_label("t", p.split_us).alias("split"), *moves)


def _study(d: DataFrame, m: Market, by: str, cut: str) -> DataFrame:
    g = d.groupBy("sym", F.col(by).alias("group")).agg(F.count(F.lit(1)).alias("n"), F.median("cnotl").alias("cnotl_med"), *[F.avg(f"signed_{h}s").alias(f"signed_{h}s") for h in m.params.study_s])
    return g.withColumn("cut", F.lit(cut))


def event_study_quintile(m: Market) -> DataFrame:
    d = stats.qcut(event_moves(m), "cnotl", 5, ["sym"], "__q")
    return _study(d.withColumn("group", F.concat(F.lit("Q"), (F.col("__q") + 1).cast("string"))), m, "group", "cluster_notional_quintile")


def event_study_membership(m: Market) -> DataFrame:
    return _study(event_moves(m), m, "membership", "exchange_membership")


def adverse_selection(m: Market) -> DataFrame:
    """Trade notional in the ``post_bins`` bins from an event's own bin on, against the mean rate;
    venue 2 at its unshifted times. Events outside the trades' range of bins do not count."""
    p = m.params
    tb = m.trades.groupBy("sym", S.time_bin("timestamp", p.bin_us).alias("b")).agg(F.sum(S.notional()).alias("notl"))
    tot = tb.groupBy("sym").agg(F.min("b").alias("b0"), F.max("b").alias("b1"), F.sum("notl").alias("total"))
    tot = tot.withColumn("baseline", F.col("total") / (F.col("b1") - F.col("b0") + 1) * p.post_bins)
    ev = m.events(0).select("sym", S.time_bin("t", p.bin_us).alias("b"), "stream")
    line = tb.withColumn("stream", F.lit(None).cast("string")).unionByName(ev.withColumn("notl", F.lit(None).cast("double")))
    w = Window.partitionBy("sym").orderBy("b")
    cum = lambda k: F.coalesce(F.sum("notl").over(w.rangeBetween(Window.unboundedPreceding, k)), F.lit(0.0))
    d = line.withColumn("post", cum(p.post_bins - 1) - cum(-1)).where("stream IS NOT NULL").join(tot, "sym")
    # the dense grid of the definition has 10 spare bins after the last
    d = d.where((F.col("b") >= F.col("b0")) & (F.col("b") - F.col("b0") + p.post_bins < F.col("b1") - F.col("b0") + 12))
    g = d.groupBy("sym", "stream").agg(F.max("baseline").alias("baseline"), F.avg("post").alias("post_mean"), F.median("post").alias("post_median"))
    return g.withColumns({"mult_mean": F.try_divide("post_mean", "baseline"), "mult_median": F.try_divide("post_median", "baseline")})


def leadlag_response(m: Market) -> DataFrame:
    """Mean signed mid move at lags around the print; venue 2 at its unshifted times."""
    p = m.params
    q = m.events(0).select("sym", "t", "row_id", F.col("stream").alias("venue"), S.side_sign("side").alias("s"), F.col("notional").alias("notl"))
    at = {k: Request("asof", "", "mid", hi=k, beyond_null=True) for k in (0, *p.lags_us)}
    d = evaluate(q, m.events(0).limit(0), m.quotes(), at.values(), bucket_us=p.bucket_us)
    top = q.groupBy("sym", "venue").agg(F.percentile("notl", 0.9).alias("__top"))
    arr = F.array(*[F.struct(F.lit(k / 1e6).alias("lag_s"), (F.col("s") * S.bps(at[k].column, at[0].column)).alias("r")) for k in p.lags_us])
    d = d.join(top, ["sym", "venue"]).withColumn("buckets", F.when(F.col("notl") >= F.col("__top"), F.array(F.lit("all"), F.lit("top_decile"))).otherwise(F.array(F.lit("all"))))
    d = d.select("sym", "venue", F.explode("buckets").alias("bucket"), arr.alias("__lags")).select("sym", "venue", "bucket", F.inline("__lags"))
    return d.groupBy("sym", "venue", "bucket", "lag_s").agg(F.avg("r").alias("response_bps"), F.count(F.lit(1)).alias("n"))


def daily_net_pressure(m: Market) -> DataFrame:
    return m.events().groupBy("sym", S.time_bin("t", 86_400 * SECOND).alias("day_idx")).agg(F.sum(F.col("buy_notional") - F.col("sell_notional")).alias("net"))


def _offsets(m: Market) -> DataFrame:
    q = m.liq1.select("sym", F.col("timestamp").alias("t"), "row_id", "side", "price")
    r = Request("asof", "", "mid", hi=0, clip_first=True)
    d = evaluate(q, m.events(0).limit(0), m.quotes(), [r], bucket_us=m.params.bucket_us)
    return d.select("sym", "row_id", "side", S.bps(F.col("price"), r.column).alias("offset_bps"))


def price_offset(m: Market) -> DataFrame:
    """Distance of liquidation prices from the mid; before the first quote, from the first."""
    return _offsets(m).groupBy("sym", "side").agg(F.count(F.lit(1)).alias("n"), F.median("offset_bps").alias("median_bps"), F.median(F.abs("offset_bps")).alias("median_abs_bps"), F.avg("offset_bps").alias("mean_bps"))


def price_offset_overall(m: Market) -> DataFrame:
    """The same over both sides."""
    return _offsets(m).groupBy("sym").agg(F.count(F.lit(1)).alias("n"), F.median(F.abs("offset_bps")).alias("median_abs_bps"))
