"""Samples whose size is exact and which do not depend on partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sample_exact(df: DataFrame, n: int, seed: int = 42, key: str = "row_id") -> DataFrame:
    """The n rows with the smallest seeded hash of the key (all rows if there are fewer)."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def every_nth(df: DataFrame, groups: list[str], order: list[str | Column], target: int) -> DataFrame:
    """Every max(1, n // target)-th row of a group, the first included."""
    w = Window.partitionBy(*groups)
    n = F.count(F.lit(1)).over(w)
    step = F.greatest(F.lit(1), ((n - F.pmod(n, F.lit(target))) / F.lit(target)).cast("long"))
    d = df.withColumn("__i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("__step", step)
    return d.where(F.pmod("__i", "__step") == 0).drop("__i", "__step")
