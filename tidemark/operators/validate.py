"""Checks of a feature matrix: finite values, alignment with the queries, and no look-ahead."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalar import finite
from tidemark.operators.context import FeatureContext
from tidemark.operators.feature import Feature
from tidemark.operators.timeline import evaluate

INF = float("inf")


def check_finite(matrix: DataFrame, features: Sequence[str], allow_nan: bool = False) -> DataFrame:
    """A row per feature: n_nan counts NULL and NaN, n_inf infinities. One pass over the matrix."""
    aggs = [x for f in features for x in (F.count_if(F.col(f).isNull() | F.isnan(f)).alias(f"n_nan|{f}"), F.count_if(F.abs(F.col(f).cast("double")) == INF).alias(f"n_inf|{f}"))]
    one = matrix.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"`n_nan|{f}`").alias("n_nan"), F.col(f"`n_inf|{f}`").alias("n_inf")) for f in features])
    d = one.select(F.inline(rows))
    return d.withColumn("ok", (F.col("n_inf") == 0) & (F.lit(allow_nan) | (F.col("n_nan") == 0)))


def check_summary(matrix: DataFrame, features: Sequence[str], allow_nan: bool = True) -> DataFrame:
    """check_finite with the share of missing values in per cent and the range of the finite ones."""
    n = [F.count(F.lit(1)).alias("n|")]
    rng = [x for f in features for x in (F.min(F.when(finite(f), F.col(f))).alias(f"min|{f}"), F.max(F.when(finite(f), F.col(f))).alias(f"max|{f}"))]
    one = matrix.agg(*n, *rng)
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), F.col("`n|`").alias("n"), F.col(f"`min|{f}`").cast("double").alias("min"), F.col(f"`max|{f}`").cast("double").alias("max")) for f in features])
    return check_finite(matrix, features, allow_nan).join(one.select(F.inline(rows)), "feature").withColumn("nan_pct", F.try_divide(100.0 * F.col("n_nan"), F.col("n")))


def check_alignment(matrix: DataFrame, queries: DataFrame, keys: Sequence[str] = ("sym",)) -> DataFrame:
    """One row: n_rows, n_queries, n_missing, n_extra, n_repeated and ok."""
    k = [*keys, "row_id"]
    a = queries.groupBy(*k).agg(F.count(F.lit(1)).alias("__q"))
    b = matrix.groupBy(*k).agg(F.count(F.lit(1)).alias("__m"))
    j = a.join(b, k, "full_outer").select(F.coalesce("__q", F.lit(0)).alias("q"), F.coalesce("__m", F.lit(0)).alias("m"))
    d = j.agg(
        F.coalesce(F.sum("m"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum("q"), F.lit(0)).alias("n_queries"),
        F.count_if(F.col("m") < F.col("q")).alias("n_missing"), F.count_if(F.col("q") == 0).alias("n_extra"), F.count_if(F.col("m") > F.greatest("q", F.lit(1))).alias("n_repeated"),
    )
    return d.withColumn("ok", (F.col("n_missing") == 0) & (F.col("n_extra") == 0) & (F.col("n_repeated") == 0))


def check_no_lookahead(features: Sequence[Feature], ctx: FeatureContext, n_probe: int = 256, seed: int = 0, tol: float = 1e-9, exhaustive_below: int | None = 5000, n: int | None = None) -> DataFrame:
    """Recomputes the features for probe trades on data cut at t and compares, all probes in one plan:
    the time of the cut is one more partition key. Every trade is a probe up to exhaustive_below trades, or
    however many there are if it is None, else n_probe of them by a seeded hash. A row per feature: n_probe, n_violations, max_abs_diff, ok."""
    probes = ctx.queries
    if exhaustive_below is not None and (ctx.n_trades() if n is None else n) > max(n_probe, exhaustive_below):
        probes = probes.orderBy(F.xxhash64("row_id", F.lit(seed)), "row_id").limit(n_probe)
    names = [f.name for f in features]
    full = ctx.fresh()
    cols = {f.name: f.calculate(full) for f in features}
    cut = ctx.truncated(probes, list(full.requests.values()))
    a = full.evaluate(cols).select(*ctx.keys, "row_id", *names)
    b = cut.evaluate({f.name: f.calculate(cut) for f in features}).select(*ctx.keys, "row_id", *[F.col(c).alias(f"{c}|cut") for c in names])
    j = b.join(a, [*ctx.keys, "row_id"])
    diff = lambda c: F.abs(F.col(c) - F.col(f"`{c}|cut`"))
    bad = lambda c: F.when(F.col(c).isNull() & F.col(f"`{c}|cut`").isNull(), False).otherwise(F.coalesce(diff(c) > tol, F.lit(True)))
    one = j.agg(F.count(F.lit(1)).alias("n|"), *[x for c in names for x in (F.count_if(bad(c)).alias(f"v|{c}"), F.max(F.when(bad(c), diff(c))).alias(f"d|{c}"))])
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col("`n|`").alias("n_probe"), F.col(f"`v|{c}`").alias("n_violations"), F.coalesce(F.col(f"`d|{c}`").cast("double"), F.lit(0.0)).alias("max_abs_diff")) for c in names])
    return one.select(F.inline(rows)).withColumn("ok", F.col("n_violations") == 0)


def check_no_lookahead_tracked(features: Sequence[Feature], ctx: FeatureContext) -> DataFrame:
    """A row per feature: trades for which it read a source later than t. Does not see raw reads. All
    features are one plan, each with the requests that it made itself."""
    every, late = ctx.fresh(), {}
    for f in features:
        own = ctx.fresh()
        f.calculate(own)
        every.requests |= own.requests
        sources = [r.source for n, r in own.requests.items() if n not in own.untracked]
        late[f.name] = F.count_if(F.greatest(*map(F.col, sources), F.lit(None).cast("long")) > F.col("t")) if sources else F.lit(0).cast("long")
    d = evaluate(every.queries, every.events, every.quotes, every.requests.values(), every.keys, every.bucket_us, track=True)
    one = d.agg(F.count(F.lit(1)).alias("n|"), *[c.alias(f"v|{n}") for n, c in late.items()])
    rows = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(f"`v|{n}`").alias("n_violations")) for n in late])
    return one.select(F.inline(rows)).withColumn("ok", F.col("n_violations") == 0)


def validate_feature_set(features: Sequence[Feature], ctx: FeatureContext, allow_nan: bool = False, matrix: DataFrame | None = None, **kw) -> DataFrame:
    """The report: a row per feature. ``matrix`` defaults to the set's own run; a misaligned one
    skips the look-ahead checks, which then count as failed."""
    from tidemark.operators.feature_set import FeatureSet

    names = [f.name for f in features]
    m = FeatureSet(features).run(ctx) if matrix is None else matrix
    fin = check_finite(m, names, allow_nan).select("feature", F.col("ok").alias("finite_ok"), "n_nan", "n_inf")
    aligned = bool(check_alignment(m, ctx.queries, ctx.keys).first()["ok"])
    if aligned:
        look = check_no_lookahead(features, ctx, **kw).select("feature", F.col("ok").alias("lookahead_ok"), F.col("n_violations").alias("lookahead_violations"))
        tracked = check_no_lookahead_tracked(features, ctx).select("feature", F.col("ok").alias("tracked_ok"))
        d = fin.join(look, "feature").join(tracked, "feature")
    else:
        d = fin.select("*", F.lit(False).alias("lookahead_ok"), F.lit(0).cast("long").alias("lookahead_violations"), F.lit(False).alias("tracked_ok"))
    back = F.create_map(*[x for f in features for x in (F.lit(f.name), F.lit(int(f.lookback_us)))])
    return d.select(
        "feature", back[F.col("feature")].cast("long").alias("lookback_us"), "finite_ok", "n_nan", "n_inf", F.lit(aligned).alias("aligned"), "lookahead_ok", "lookahead_violations", "tracked_ok",
        (F.col("finite_ok") & F.lit(aligned) & F.col("lookahead_ok") & F.col("tracked_ok")).alias("ok"),
    )


def validate_feature(feature: Feature, ctx: FeatureContext, **kw) -> dict:
    return validate_feature_set([feature], ctx, **kw).first().asDict()
