"""Signal statistics as DataFrame plans: rank correlation, KS, PSI, deciles, autocorrelation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import finite


def average_rank(df: DataFrame, col: str, groups: Sequence[str], out: str, buckets: int = 1) -> DataFrame:
    """Rank with ties at their mean. With ``buckets`` > 1 a group is cut at approximate quantiles,
    ranked within each piece and shifted by the pieces before it, so that no task sorts a whole group;
    the result is the same for any number of buckets."""
    groups = list(groups)
    if buckets <= 1:
        w = Window.partitionBy(*groups)
        return df.withColumn(out, F.rank().over(w.orderBy(col)) + (F.count(F.lit(1)).over(w.partitionBy(*groups, col)) - 1) / 2.0)
    edges = df.groupBy(*groups).agg(F.percentile_approx(col, [i / buckets for i in range(1, buckets)], 10_000).alias("__edges"))
    cut = df.join(edges, groups) if groups else df.crossJoin(edges)
    cut = cut.withColumn("__b", F.size(F.filter("__edges", lambda e: e < F.col(col)))).drop("__edges")
    sizes = cut.groupBy(*groups, "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(Window.partitionBy(*groups).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    w = Window.partitionBy(*groups, "__b")
    ranked = cut.join(before, [*groups, "__b"])
    return ranked.withColumn(out, F.col("__before") + F.rank().over(w.orderBy(col)) + (F.count(F.lit(1)).over(w.partitionBy(*groups, "__b", col)) - 1) / 2.0).drop("__b", "__before")


def pearson(a: str, b: str) -> Column:
    """NULL where a side is constant or there are no rows."""
    var = lambda c: F.var_pop(c)
    return F.try_divide(F.covar_pop(a, b), F.sqrt(var(a) * var(b)))


def spearman(df: DataFrame, x: str, y: str, groups: Sequence[str] = (), min_n: int = 10, out: str = "ic", buckets: int = 1) -> DataFrame:
    """Pearson correlation of average ranks over the rows where both are finite; NULL below min_n."""
    groups = list(groups)
    d = df.where(finite(x) & finite(y)).select(*groups, F.col(x).alias("__x"), F.col(y).alias("__y"))
    d = average_rank(average_rank(d, "__x", groups, "__rx", buckets), "__y", groups, "__ry", buckets)
    return d.groupBy(*groups).agg(F.when(F.count(F.lit(1)) >= min_n, pearson("__rx", "__ry")).alias(out), F.count(F.lit(1)).alias("n"))


def ks_separation(df: DataFrame, x: str, positive: Column, groups: Sequence[str] = (), out: str = "ks") -> DataFrame:
    """max |F_a - F_b| between the rows where ``positive`` holds and the others; NULL if a class is empty."""
    groups = list(groups)
    d = df.where(finite(x)).groupBy(*groups, F.col(x).alias("__x")).agg(F.count_if(positive).alias("__a"), F.count_if(~positive).alias("__b"))
    w = Window.partitionBy(*groups)
    run = w.orderBy("__x").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("__d", F.abs(F.try_divide(F.sum("__a").over(run), F.sum("__a").over(w)) - F.try_divide(F.sum("__b").over(run), F.sum("__b").over(w))))
    return d.groupBy(*groups).agg(F.max("__d").alias(out))


def ordered_unique(df: DataFrame, col: str, order: Sequence[str]) -> DataFrame:
    """The distinct values of a column and their places, from 0, by first appearance in the order."""
    first = df.groupBy(col).agg(F.min(F.struct(*order)).alias("__first"))
    return first.select((F.row_number().over(Window.orderBy("__first")) - 1).alias("place"), col)


def describe(df: DataFrame, columns: Sequence[str], name: str = "feature") -> DataFrame:
    """A row per column: n, mean, std (of a sample), min and max of the finite values. One pass."""
    aggs = [f(F.when(finite(c), F.col(c).cast("double"))).alias(f"{k}|{c}") for c in columns for k, f in (("n", F.count), ("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))]
    rows = F.array(*[F.struct(F.lit(c).alias(name), *[F.col(f"`{k}|{c}`").alias(k) for k in ("n", "mean", "std", "min", "max")]) for c in columns])
    return df.agg(*aggs).select(F.inline(rows))


def quantile_edges(df: DataFrame, x: str, qs: Sequence[float], groups: Sequence[str], accuracy: int | None = None) -> DataFrame:
    """One row per group with the array ``edges``; exact unless an accuracy is given."""
    agg = F.percentile_approx(x, list(qs), accuracy) if accuracy else F.percentile(x, F.array(*[F.lit(float(q)) for q in qs]))
    return df.where(finite(x)).groupBy(*groups).agg(agg.alias("edges"))


def bucket_right_closed(x: str) -> Column:
    """Quantile bin 0.. of x among the inner ``edges``: (e[i-1], e[i]]."""
    return F.size(F.filter("edges", lambda e: e < F.col(x)))


def bucket_left_closed(x: str) -> Column:
    return F.size(F.filter("edges", lambda e: e <= F.col(x)))


def qcut(df: DataFrame, x: str, k: int, groups: Sequence[str], out: str) -> DataFrame:
    edges = quantile_edges(df, x, [i / k for i in range(1, k)], groups)
    return df.join(edges, list(groups)).withColumn(out, F.when(finite(x), bucket_right_closed(x))).drop("edges")


def psi(df: DataFrame, x: str, is_train: Column, groups: Sequence[str], bins: int = 10, min_n: int = 100, out: str = "psi") -> DataFrame:
    """Population stability index with train-quantile edges, left-closed bins, open ends and 1e-6 added."""
    groups = list(groups)
    d = df.where(finite(x)).withColumn("__train", is_train)
    edges = quantile_edges(d.where("__train"), x, [i / bins for i in range(1, bins)], groups)
    d = d.join(edges, groups).withColumn("__bin", bucket_left_closed(x))
    per = d.groupBy(*groups, "__bin").agg(F.count_if("__train").alias("__t"), F.count_if(~F.col("__train")).alias("__v"))
    tot = per.groupBy(*groups).agg(F.sum("__t").alias("__nt"), F.sum("__v").alias("__nv"), F.collect_list(F.struct("__bin", "__t", "__v")).alias("__bins"))
    every = tot.withColumn("__bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    hit = lambda name: F.coalesce(F.aggregate(F.filter("__bins", lambda s: s["__bin"] == F.col("__bin")), F.lit(0).cast("long"), lambda acc, s: acc + s[name]), F.lit(0))
    p, q = F.try_divide(hit("__t"), F.col("__nt")) + 1e-6, F.try_divide(hit("__v"), F.col("__nv")) + 1e-6
    return every.withColumn("__term", (q - p) * F.ln(q / p)).groupBy(*groups).agg(
        F.when((F.max("__nt") >= min_n) & (F.max("__nv") >= min_n), F.sum("__term")).alias(out)
    )


def ordinal_decile(df: DataFrame, x: str, groups: Sequence[str], tie: str, out: str) -> DataFrame:
    """int(rank / (n + 1) * 10) clipped to 0..9; ties by ``tie``. NULL values rank first."""
    w = Window.partitionBy(*groups)
    r = F.row_number().over(w.orderBy(x, tie))
    return df.withColumn(out, F.least(F.greatest((r * 10 / (F.count(F.lit(1)).over(w) + 1)).cast("int"), F.lit(0)), F.lit(9)))


def autocorrelation(df: DataFrame, x: str, order: str, lags: Sequence[int], groups: Sequence[str]) -> DataFrame:
    """Biased autocorrelation: lagged products of the centred series over its whole sum of squares."""
    groups = list(groups)
    w = Window.partitionBy(*groups)
    d = df.withColumn("__c", F.col(x) - F.avg(x).over(w))
    o = w.orderBy(order)
    d = d.select(*groups, "__c", *[(F.col("__c") * F.lag("__c", k).over(o)).alias(f"__p{k}") for k in lags])
    agg = d.groupBy(*groups).agg(F.sum(F.col("__c") * F.col("__c")).alias("__ss"), *[F.sum(f"__p{k}").alias(f"__p{k}") for k in lags])
    stack = ", ".join(f"{k}, __p{k}" for k in lags)
    return agg.select(*groups, "__ss", F.expr(f"stack({len(lags)}, {stack}) as (lag, __p)")).select(*groups, "lag", F.try_divide("__p", "__ss").alias("acf"))


def ecdf(df: DataFrame, x: str, groups: Sequence[str], survival: bool = False, out: str = "p") -> DataFrame:
    """(i - 1) / n of the i-th sorted value, or one less it; ties get successive steps."""
    w = Window.partitionBy(*groups)
    p = (F.row_number().over(w.orderBy(x)) - 1) / F.count(F.lit(1)).over(w)
    return df.withColumn(out, 1 - p if survival else p)


def binned_mutual_info(df: DataFrame, x: str, y: str, groups: Sequence[str], bins: int = 16, out: str = "mi") -> DataFrame:
    """Mutual information in nats of quantile-binned x and y; ties share a bin."""
    groups = list(groups)
    d = df.where(finite(x) & finite(y)).select(*groups, F.col(x).alias("__x"), F.col(y).alias("__y"))
    d = qcut(qcut(d, "__x", bins, groups, "__i"), "__y", bins, groups, "__j")
    c = d.groupBy(*groups, "__i", "__j").agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(*groups)
    n, ni, nj = F.sum("__n").over(w), F.sum("__n").over(w.partitionBy(*groups, "__i")), F.sum("__n").over(w.partitionBy(*groups, "__j"))
    c = c.withColumn("__t", F.col("__n") / n * F.ln(F.col("__n") * n / (ni * nj)))
    return c.groupBy(*groups).agg(F.greatest(F.sum("__t"), F.lit(0.0)).alias(out))
