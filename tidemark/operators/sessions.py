"""Gap sessions: a new cluster begins where the gap to the row before is larger than gap_us."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_cluster(df: DataFrame, gap_us: int, keys: Sequence[str] = ("sym",)) -> DataFrame:
    """Adds cid, counted from 1 in each key. Equal times share a cluster whatever their order."""
    w = Window.partitionBy(*keys).orderBy("t", "stream", "row_id")
    new = F.coalesce(F.col("t") - F.lag("t").over(w) > F.lit(gap_us), F.lit(True))
    return df.withColumn("__new", new.cast("int")).withColumn("cid", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def clusters(events: DataFrame, gap_us: int, keys: Sequence[str] = ("sym",)) -> DataFrame:
    d = with_cluster(events, gap_us, keys)
    venue = lambda v: F.count_if(F.col("stream") == v)
    g = d.groupBy(*keys, "cid").agg(
        F.min("t").alias("t0"), F.max("t").alias("t1"), F.count(F.lit(1)).alias("n"), F.sum("notional").alias("notional"),
        venue("liq_exchange_1").alias("n_exchange_1"), venue("liq_exchange_2").alias("n_exchange_2"),
        F.sum("buy_notional").alias("buy_notional"), F.sum("sell_notional").alias("sell_notional"),
    )
    return g.withColumns({
        "dur_s": (F.col("t1") - F.col("t0")) / 1e6,
        "multi_ex": (F.col("n_exchange_1") > 0) & (F.col("n_exchange_2") > 0),
        "side_imb": F.try_divide(F.col("buy_notional") - F.col("sell_notional"), F.col("buy_notional") + F.col("sell_notional")),
    })


def cascades(found: DataFrame, min_n: int, min_notional: float, max_s: float) -> DataFrame:
    return found.where((F.col("n") >= min_n) & (F.col("notional") >= min_notional) & (F.col("dur_s") <= max_s))


def near_other(events: DataFrame, near_us: int, keys: Sequence[str] = ("sym",)) -> DataFrame:
    """Adds near: is there an event of the other venue within [t - near, t + near]? One Window."""
    w = Window.partitionBy(*keys).orderBy("t")
    cum = lambda v, b: F.coalesce(F.sum(F.when(F.col("stream") == v, 1)).over(w.rangeBetween(Window.unboundedPreceding, b)), F.lit(0))
    n = lambda v: cum(v, near_us) - cum(v, -near_us - 1)
    return events.withColumn("near", F.when(F.col("stream") == "liq_exchange_1", n("liq_exchange_2")).otherwise(n("liq_exchange_1")) > 0)
