"""A set of features as one plan: requests are gathered, fused into one Window and projected."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.context import FeatureContext
from tidemark.operators.feature import Feature


class FeatureSet:
    def __init__(self, features: Sequence[Feature]) -> None:
        self.features = list(features)
        names = [f.name for f in self.features]
        if len(set(names)) != len(names):
            raise ValueError("feature names must be unique")

    def run(self, ctx: FeatureContext, keep: Sequence[str] = ()) -> DataFrame:
        """keys, row_id, timestamp and a column per feature; a row per query. The order of rows is not
        fixed; sort by timestamp, row_id where it matters."""
        ctx = ctx.fresh()
        cols = {f.name: f.calculate(ctx) for f in self.features}
        d = ctx.evaluate(cols)
        return d.select(*ctx.keys, "row_id", F.col("t").alias("timestamp"), *keep, *cols)

    def validate(self, ctx: FeatureContext, **kw) -> DataFrame:
        from tidemark.operators.validate import validate_feature_set

        return validate_feature_set(self.features, ctx, **kw)

    def run_to(self, ctx: FeatureContext, out_path: str, keep: Sequence[str] = ()) -> str:
        """Writes the matrix as Parquet (0 rows keep the schema); Spark's tasks and spill bound memory."""
        self.run(ctx, keep).write.mode("overwrite").parquet(out_path)
        return out_path
