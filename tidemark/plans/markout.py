"""Markout, rule scores and signal tables over the feature sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scalar as S
from tidemark.functions import stats
from tidemark.operators.analyze import unpivot
from tidemark.operators.feature_set import FeatureSet
from tidemark.operators.library import default_features
from tidemark.operators.sample import every_nth, sample_exact
from tidemark.operators.timeline import Request, evaluate
from tidemark.schema import SECOND
from tidemark.sources.events import Market


def features(m: Market):
    p = m.params
    return default_features(p.short_us // SECOND, p.long_us // SECOND, p.ret_us // SECOND)


def names(m: Market) -> list[str]:
    return [f.name for f in features(m)]


def feature_matrix(m: Market) -> DataFrame:
    return FeatureSet(features(m)).run(m.context())


def _pnl(m: Market, ctx) -> dict[str, Column]:
    return {f"pnl_{h}": S.markout(F.col("s"), ctx.asof("mid", h * SECOND), F.col("price"), m.params.rebate_bps) for h in m.params.horizons_s}


def feature_sample(m: Market, n: int | None = None, seed: int = 42) -> DataFrame:
    """Features, pnl_<horizon>, s, w and split per trade; optionally of an exact-size sample."""
    ctx = m.context()
    if n:
        ctx.queries = sample_exact(ctx.queries, n, seed)
    cols = {f.name: f.calculate(ctx) for f in features(m)} | _pnl(m, ctx)
    d = ctx.evaluate(cols)
    return d.select("sym", "row_id", F.col("t").alias("timestamp"), "s", "w", S.split_label("t", m.params.split_us).alias("split"), *cols)


def long_pnl(d: DataFrame, m: Market, keep: list[str]) -> DataFrame:
    hs = m.params.horizons_s
    return d.select(*keep, F.expr(f"stack({len(hs)}, {', '.join(f'{h}, pnl_{h}' for h in hs)}) as (tau, pnl)"))


def weighted_mean(value: str, weight: str) -> Column:
    return F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(weight))


def markout_baseline(m: Market) -> DataFrame:
    ctx = m.context()
    d = ctx.evaluate(_pnl(m, ctx)).withColumn("split", S.split_label("t", m.params.split_us))
    d = long_pnl(d, m, ["sym", "split", "w"]).where(S.finite("pnl"))
    return d.groupBy("sym", "split", "tau").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("wsum"), weighted_mean("pnl", "w").alias("pnl_all"))


def pivoted(d: DataFrame, keys: list[str], on: str, values: list, value: str) -> DataFrame:
    return d.groupBy(*keys).pivot(on, values).agg(F.first(value))


def rule_scores(m: Market, sample: DataFrame | None = None) -> DataFrame:
    """Weighted PnL of all trades and of those that a rule keeps; all rules in one pass."""
    p = m.params
    d = feature_sample(m) if sample is None else sample
    liq, imb = F.col(f"liq_notional_{p.short_us // SECOND}s"), F.col(f"liq_side_imbalance_{p.short_us // SECOND}s")
    rules = [("symmetric_notional", x, liq >= x) for x in p.symmetric] + [("directional_adverse", x, (F.col("s") * imb > 0) & (liq >= x)) for x in p.directional]
    d = d.withColumn("rules", F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(float(x)).alias("param"), c.alias("filt")) for r, x, c in rules]))
    d = long_pnl(d, m, ["sym", "split", "w", "rules"]).where(S.finite("pnl")).select("sym", "split", "tau", "w", "pnl", F.inline("rules"))
    kept = ~F.col("filt")
    g = d.groupBy("sym", "rule", "param", "tau", "split").agg(
        weighted_mean("pnl", "w").alias("pnl_all"),
        F.try_divide(F.sum(F.when(kept, F.col("w") * F.col("pnl"))), F.sum(F.when(kept, F.col("w")))).alias("pnl_kept"),
        F.round(100.0 * F.count_if(kept) / F.count(F.lit(1)), 1).alias("kept_pct"),
    )
    return g.withColumn("score", F.col("pnl_kept") - F.col("pnl_all"))


def ic_table(m: Market, sample: DataFrame | None = None) -> DataFrame:
    d = feature_sample(m) if sample is None else sample
    pn = [f"pnl_{h}" for h in m.params.horizons_s]
    long = unpivot(d, names(m), ["sym", "split", *pn])
    return stats.spearman(long_pnl(long, m, ["sym", "feature", "split", "value"]), "value", "pnl", ["sym", "feature", "split", "tau"], 100, buckets=m.params.rank_buckets)


def psi_table(m: Market, sample: DataFrame | None = None) -> DataFrame:
    d = feature_sample(m) if sample is None else sample
    return stats.psi(unpivot(d, names(m), ["sym", "split"]), "value", F.col("split") == "train", ["sym", "feature"])


def decile_table(m: Market, tau: int | None = None, sample: DataFrame | None = None) -> DataFrame:
    h = tau or m.params.horizons_s[1]
    d = (feature_sample(m) if sample is None else sample).where("split = 'val'")
    long = stats.qcut(unpivot(d, names(m), ["sym", f"pnl_{h}"]), "value", 10, ["sym", "feature"], "dec")
    return long.groupBy("sym", "feature", "dec").agg(F.avg(f"pnl_{h}").alias("pnl"), F.median("value").alias("fmed"), F.count(F.lit(1)).alias("n"))


def spearman_matrix(m: Market, sample: DataFrame | None = None) -> DataFrame:
    """Pairs of features, each over the rows where both are finite; 1 on the diagonal."""
    d = feature_sample(m) if sample is None else sample
    fs = names(m)
    pairs = [(a, b) for i, a in enumerate(fs) for b in fs[i + 1 :]]
    arr = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).alias("x"), F.col(b).alias("y")) for a, b in pairs])
    s = stats.spearman(d.select("sym", F.inline(arr)), "x", "y", ["sym", "a", "b"], 100, "rho", m.params.rank_buckets).select("sym", "a", "b", "rho")
    diag = d.select("sym").distinct().select("sym", F.explode(F.array(*[F.lit(f) for f in fs])).alias("a")).select("sym", "a", F.col("a").alias("b"), F.lit(1.0).alias("rho"))
    return s.unionByName(s.select("sym", F.col("b").alias("a"), F.col("a").alias("b"), "rho")).unionByName(diag)


def ks_table(m: Market, sample: DataFrame | None = None) -> DataFrame:
    """Separation of toxic (markout below 0 at the second horizon) from other trades."""
    h = m.params.horizons_s[1]
    d = (feature_sample(m) if sample is None else sample).where(S.finite(f"pnl_{h}"))
    return stats.ks_separation(unpivot(d, names(m), ["sym", f"pnl_{h}"]), "value", F.col(f"pnl_{h}") < 0, ["sym", "feature"])


def conditional_base(m: Market, sample: DataFrame | None = None) -> DataFrame:
    p = m.params
    short = f"{p.short_us // SECOND}s"
    g = ["sym", "split"]
    d = (feature_sample(m) if sample is None else sample).withColumns({"imb_against": F.col("s") * F.col("bbo_imbalance"), "liq_against": F.col("s") * F.col(f"liq_side_imbalance_{short}"), "liqn": F.col(f"liq_notional_{short}")})
    d = stats.ordinal_decile(d, "imb_against", g, "row_id", "dec")
    half = d.where("liqn > 0").groupBy(*g).agg(F.percentile("liqn", 0.5).alias("__half"))
    d = d.join(half, g, "left").withColumn("active", F.coalesce(F.col("liqn") >= F.col("__half"), F.lit(False)))
    return long_pnl(d, m, [*g, "row_id", "imb_against", "liq_against", "liqn", "dec", "active"])


def conditional_ic(m: Market, sample: DataFrame | None = None) -> DataFrame:
    from pyspark.sql import Window

    g = ["sym", "split", "tau"]
    d = conditional_base(m, sample).where(S.finite("pnl"))
    d = d.withColumn("resid", F.col("pnl") - F.avg("pnl").over(Window.partitionBy(*g, "dec")))
    five = [("ic_imb_against", "imb_against", "pnl"), ("ic_liq_against_raw", "liq_against", "pnl"), ("ic_liq_against_resid", "liq_against", "resid"), ("ic_liqn_raw", "liqn", "pnl"), ("ic_liqn_resid", "liqn", "resid")]
    long = d.select(*g, F.inline(F.array(*[F.struct(F.lit(n).alias("which"), F.col(x).alias("x"), F.col(y).alias("y")) for n, x, y in five])))
    return pivoted(stats.spearman(long, "x", "y", [*g, "which"], 2, buckets=m.params.rank_buckets), g, "which", [n for n, _, _ in five], "ic")


def conditional_means(m: Market, sample: DataFrame | None = None) -> DataFrame:
    d = conditional_base(m, sample)
    ag, wi = F.col("active") & (F.col("liq_against") > 0.2), F.col("active") & (F.col("liq_against") < -0.2)
    g = d.groupBy("sym", "split", "tau").agg(
        F.avg("pnl").alias("baseline"), F.avg(F.when(ag, F.col("pnl"))).alias("against"), F.avg(F.when(wi, F.col("pnl"))).alias("with_push"), F.count_if(ag).alias("n_against"), F.count_if(wi).alias("n_with")
    )
    return g.withColumn("spread", F.col("against") - F.col("with_push"))


def imbalance_ic(m: Market) -> DataFrame:
    """IC of queue imbalance and microprice deviation with the forward mid, at strided quotes."""
    p = m.params
    q = m.bbo.select("sym", F.col("timestamp").alias("t"), "row_id", S.mid().alias("m0"), S.imbalance().alias("imb"), S.microprice_dev().alias("dev"))
    q = every_nth(q, ["sym"], ["t", "row_id"], p.stride_target)
    reqs = [Request("asof", "", "mid", hi=h * SECOND, beyond_null=True) for h in p.imbalance_s]
    d = evaluate(q, m.events(0).limit(0), m.quotes(), reqs, bucket_us=p.bucket_us)
    arr = F.array(*[F.struct(F.lit(h).alias("horizon_s"), S.bps(r.column, F.col("m0")).alias("fwd")) for h, r in zip(p.imbalance_s, reqs, strict=True)])
    long = d.select("sym", "imb", "dev", F.inline(arr))
    g = ["sym", "horizon_s"]
    a, b = (stats.spearman(long, x, "fwd", g, 2, out, p.rank_buckets).drop("n") for x, out in (("imb", "ic_imbalance"), ("dev", "ic_microprice")))
    return a.join(b, g)
