"""Data quality profiles and activity tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scalar as S
from tidemark.functions import stats
from tidemark.schema import DAY
from tidemark.sources.events import Market

pct = lambda cond: 100.0 * F.count_if(cond) / F.count(F.lit(1))


def feeds(m: Market) -> DataFrame:
    cols = ["sym", "row_id", "timestamp", "side", "price", "amount"]
    return m.liq1.select(*cols, F.lit("exchange_1").alias("feed")).unionByName(m.liq2.select(*cols, F.lit("exchange_2").alias("feed")))


def with_gap(df: DataFrame, keys: list[str], order: str = "row_id") -> DataFrame:
    """gap_s to the row before, by time."""
    return df.withColumn("gap_s", (F.col("timestamp") - F.lag("timestamp").over(Window.partitionBy(*keys).orderBy("timestamp", order))) / 1e6)


def liq_quirks(m: Market) -> DataFrame:
    k = ["feed", "sym"]
    same = lambda *c: F.count(F.lit(1)).over(Window.partitionBy(*k, *c)) > 1
    d = with_gap(feeds(m), k).withColumns({"dup_ts": same("timestamp"), "dup_row": same("timestamp", "side", "price", "amount")})
    return d.groupBy(*k).agg(
        F.count(F.lit(1)).alias("rows"), pct(F.pmod("timestamp", F.lit(1000)) == 0).alias("pct_ms_granular"), pct(F.col("dup_ts")).alias("dup_ts_pct"), F.count_if("dup_row").alias("exact_dup_rows"),
        F.min("gap_s").alias("min_gap_s"), F.percentile("gap_s", 0.01).alias("p1_gap_s"), F.median("gap_s").alias("median_gap_s"), pct(F.col("side") == "sell").alias("sell_pct"),
        pct(S.funding_distance_s("timestamp") < 60).alias("funding_within60_pct"), pct(S.is_weekend("timestamp")).alias("weekend_pct"),
    )


def bbo_quirks(m: Market) -> DataFrame:
    d = with_gap(m.bbo, ["sym"])
    return d.groupBy("sym").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("bid_price") > F.col("ask_price")).alias("crossed"), F.count_if(F.col("bid_price") == F.col("ask_price")).alias("locked"),
        F.count_if((F.col("bid_amount") <= 0) | (F.col("ask_amount") <= 0)).alias("zero_size"), F.min(F.col("ask_price") - F.col("bid_price")).alias("tick"), pct(F.pmod("timestamp", F.lit(1000)) == 0).alias("pct_ms_granular"),
        F.max("gap_s").alias("max_gap_s"), F.count_if(F.col("gap_s") >= 10).alias("n_gaps_ge_10s"), (100.0 * F.countDistinct("timestamp") / F.count(F.lit(1))).alias("distinct_ts_pct"),
    )


def gap_histogram(m: Market) -> DataFrame:
    ms = F.col("gap_s") * 1000
    label = F.when(ms < 1, "0 <1ms").when(ms < 10, "1 1-10ms").when(ms < 100, "2 10-100ms").when(ms < 1000, "3 0.1-1s").when(ms < 10000, "4 1-10s").otherwise("5 >10s")
    return with_gap(m.bbo, ["sym"]).where("gap_s IS NOT NULL").groupBy("sym", label.alias("bucket")).agg(F.count(F.lit(1)).alias("c"))


def _fills(m: Market) -> DataFrame:
    return m.trades.groupBy("sym", "timestamp").agg(F.count(F.lit(1)).alias("fills"))


def burst_stats(m: Market) -> DataFrame:
    a = _fills(m).groupBy("sym").agg(F.sum("fills").alias("rows"), F.count(F.lit(1)).alias("distinct_ts"), F.max("fills").alias("max_fills"), F.count_if(F.col("fills") >= m.params.burst).alias("ts_in_burst"))
    g = with_gap(m.trades, ["sym"]).groupBy("sym").agg(F.max("gap_s").alias("max_gap_s"), F.count_if(F.col("gap_s") > 10).alias("n_gaps_gt_10s"), F.count_if(F.col("gap_s") > 5).alias("n_gaps_gt_5s"))
    return a.join(g, "sym").withColumn("distinct_ts_pct", 100.0 * F.col("distinct_ts") / F.col("rows"))


def burst_histogram(m: Market, top: int = 60) -> DataFrame:
    return _fills(m).groupBy("sym", F.least("fills", F.lit(top)).alias("fills")).agg(F.count(F.lit(1)).alias("n"))


def daily_price(m: Market) -> DataFrame:
    return m.trades.groupBy("sym", S.time_bin("timestamp", DAY).alias("day_idx")).agg(
        F.max_by("price", F.struct("timestamp", "row_id")).alias("last_price"), F.min("price").alias("lo"), F.max("price").alias("hi"), F.sum(S.notional()).alias("notional"), F.count(F.lit(1)).alias("n")
    )


def inventory(m: Market) -> DataFrame:
    k = ["feed", "sym"]
    prev = F.lag("timestamp").over(Window.partitionBy(*k).orderBy("row_id"))
    d = feeds(m).withColumns({"back": F.col("timestamp") < prev, "dup": F.count(F.lit(1)).over(Window.partitionBy(*k, "timestamp")) > 1, "notl": S.notional()})
    nulls: Column = reduce(lambda a, c: a + F.col(c).isNull().cast("int"), ["side", "price", "amount"], F.col("timestamp").isNull().cast("int"))
    return d.groupBy(*k).agg(
        F.count(F.lit(1)).alias("rows"), F.min("timestamp").alias("t_min"), F.max("timestamp").alias("t_max"), (F.count_if("back") == 0).alias("monotonic"), F.round(pct(F.col("dup")), 2).alias("dup_ts_pct"),
        F.sum(nulls).alias("nulls"), (F.count_if(F.col("price") <= 0) + F.count_if(F.col("amount") <= 0)).alias("nonpos"), F.round(pct(F.col("side") == "buy"), 1).alias("buy_pct"),
        F.median("notl").alias("notl_med"), F.percentile("notl", 0.99).alias("notl_p99"), F.sum("notl").alias("notl_sum"),
        F.count_if(F.col("timestamp") < m.params.split_us).alias("train"), F.count_if(F.col("timestamp") >= m.params.split_us).alias("val"),
    )


def daily_activity(m: Market) -> DataFrame:
    d = feeds(m).groupBy("feed", "sym", S.time_bin("timestamp", DAY).alias("day_idx")).agg(F.count(F.lit(1)).alias("events"), F.sum(S.notional()).alias("notional"))
    return d


def activity_ratio(m: Market) -> DataFrame:
    """Events and notional a day, in the later part over the earlier."""
    p = m.params
    d = feeds(m).withColumn("val", F.col("timestamp") >= p.split_us)
    n = lambda v, c: F.sum(F.when(F.col("val") == v, c))
    per = lambda c: F.try_divide(n(True, c) / float(p.val_days), n(False, c) / float(p.train_days))
    return d.groupBy("feed", "sym").agg(per(F.lit(1.0)).alias("events_ratio"), per(S.notional()).alias("notional_ratio"))


def hour_share(m: Market) -> DataFrame:
    d = feeds(m).groupBy("feed", "sym", S.to_hour("timestamp").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    return d.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("feed", "sym")))


def interarrival_stats(m: Market) -> DataFrame:
    d = with_gap(feeds(m), ["feed", "sym"]).where("gap_s IS NOT NULL")
    return d.groupBy("feed", "sym").agg(
        F.avg("gap_s").alias("mean_s"), F.median("gap_s").alias("median_s"), F.try_divide(F.stddev_pop("gap_s"), F.avg("gap_s")).alias("cv"), pct(F.col("gap_s") < m.params.gap_us / 1e6).alias("below_gap_pct")
    )


def interarrival_survival(m: Market) -> DataFrame:
    d = with_gap(feeds(m), ["feed", "sym"]).where("gap_s > 0").select("feed", "sym", "gap_s")
    return stats.ecdf(d, "gap_s", ["feed", "sym"], survival=True)


def funding_clustering(m: Market) -> DataFrame:
    """Share of events within a minute of a funding time, and over that of uniform times."""
    d = feeds(m).groupBy("feed", "sym").agg((F.count_if(S.funding_distance_s("timestamp") < 60) / F.count(F.lit(1))).alias("share"))
    return d.withColumn("lift", F.col("share") / (3 * 120 / 86400))


def _net_bins(m: Market) -> DataFrame:
    p = m.params
    signed = S.side_sign("side") * F.col("amount")
    d = m.trades.groupBy("sym", S.time_bin("timestamp", p.acf_bin_us).alias("b")).agg(F.sum(signed).alias("net"), F.max_by("price", F.struct("timestamp", "row_id")).alias("px"))
    return d.withColumn("window", S.split_label(F.col("b") * p.acf_bin_us, p.split_us))


def orderflow_acf(m: Market) -> DataFrame:
    """Autocorrelation of the sign of net signed volume over the bins that have any."""
    d = _net_bins(m).withColumn("sign", F.signum("net")).where("sign <> 0")
    return stats.autocorrelation(d, "sign", "b", m.params.acf_lags, ["sym", "window"])


def return_autocorr(m: Market) -> DataFrame:
    """Lag-1 correlation of the log returns that are not zero."""
    w = Window.partitionBy("sym", "window").orderBy("b")
    d = _net_bins(m).withColumn("r", F.ln("px") - F.ln(F.lag("px").over(w))).where("r <> 0").withColumn("r1", F.lag("r").over(w)).where("r1 IS NOT NULL")
    return d.groupBy("sym", "window").agg(stats.pearson("r1", "r").alias("lag1_autocorr"))
