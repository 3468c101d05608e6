"""Analyzers: feature x analyzer tables against a target."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import stats
from tidemark.functions.scalar import finite


class FeatureAnalyzer(ABC):
    name: str

    @abstractmethod
    def analyze(self, long: DataFrame) -> DataFrame:
        """From (row_id, feature, value, target) to (feature, <name>)."""


class SpearmanIC(FeatureAnalyzer):
    name = "spearman_ic"

    def __init__(self, min_n: int = 10, buckets: int = 1) -> None:
        self.min_n, self.buckets = min_n, buckets

    def analyze(self, long: DataFrame) -> DataFrame:
        return stats.spearman(long, "value", "target", ["feature"], self.min_n, self.name, self.buckets).drop("n")


class KSSeparation(FeatureAnalyzer):
    name = "ks"

    def __init__(self, threshold: float = 0.5) -> None:
        self.threshold = threshold

    def analyze(self, long: DataFrame) -> DataFrame:
        return stats.ks_separation(long.where(finite("target")), "value", F.col("target") > self.threshold, ["feature"], self.name)


class MutualInfo(FeatureAnalyzer):
    name = "mutual_info"

    def __init__(self, bins: int = 16) -> None:
        self.bins = bins

    def analyze(self, long: DataFrame) -> DataFrame:
        return stats.binned_mutual_info(long, "value", "target", ["feature"], self.bins, self.name)


class TreeR2(FeatureAnalyzer):
    """Out-of-sample R2 of a random forest of one feature; the tail of row_id is the test part."""

    name = "tree_r2"

    def __init__(self, test_frac: float = 0.3, seed: int = 42, trees: int = 50, depth: int = 5, min_n: int = 50) -> None:
        self.test_frac, self.seed, self.trees, self.depth, self.min_n = test_frac, seed, trees, depth, min_n

    def analyze(self, long: DataFrame) -> DataFrame:
        from pyspark.ml.feature import VectorAssembler
        from pyspark.ml.regression import RandomForestRegressor

        rows = []
        # each forest is several jobs: the rows are computed once
        d = long.where(finite("value") & finite("target"))
        shared = d.sparkSession.conf.get("spark.checkpoint.dir", None)
        d = d.checkpoint() if shared else d.persist()
        cuts = {r["feature"]: r for r in d.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.percentile("row_id", 1 - self.test_frac).alias("cut")).collect()}
        for (feature,) in sorted(long.select("feature").distinct().collect()):
            r2, c = None, cuts.get(feature)
            if c and c["n"] >= self.min_n:
                part = VectorAssembler(inputCols=["value"], outputCol="v").transform(d.where(F.col("feature") == feature))
                model = RandomForestRegressor(featuresCol="v", labelCol="target", numTrees=self.trees, maxDepth=self.depth, seed=self.seed).fit(part.where(F.col("row_id") <= c["cut"]))
                e = model.transform(part.where(F.col("row_id") > c["cut"])).agg(F.sum(F.pow(F.col("target") - F.col("prediction"), 2)).alias("sse"), (F.var_pop("target") * F.count(F.lit(1))).alias("sst")).first()
                r2 = 1 - e["sse"] / e["sst"] if e["sst"] else None
            rows.append((feature, r2))
        return long.sparkSession.createDataFrame(rows, f"feature string, {self.name} double")


def unpivot(matrix: DataFrame, features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    return matrix.unpivot([F.col(c) for c in keep], [F.col(f).cast("double").alias(f) for f in features], "feature", "value")


def analyze_features(matrix: DataFrame, target: str, analyzers: Sequence[FeatureAnalyzer], features: Sequence[str] | None = None) -> DataFrame:
    """feature and a column per analyzer; all features are analysed in one plan."""
    features = list(features or [c for c in matrix.columns if c not in {"timestamp", "row_id", "sym", target}])
    m = matrix.withColumn("target", F.col(target).cast("double")).select("row_id", "target", *features)
    long = unpivot(m, features, ["row_id", "target"])
    out = long.select("feature").distinct()
    for a in analyzers:
        out = out.join(a.analyze(long), "feature", "left")
    return out


def rank_features(matrix: DataFrame, target: str, features: Sequence[str] | None = None) -> DataFrame:
    """IC, and KS of the rows whose target is negative, by falling |IC|."""
    toxic = matrix.withColumn("__neg", (F.col(target) < 0).cast("double"))
    names = list(features or [c for c in matrix.columns if c not in {"timestamp", "row_id", "sym", target}])
    ic = analyze_features(matrix.select("row_id", target, *names), target, [SpearmanIC()], names)
    ks = analyze_features(toxic.select("row_id", "__neg", *names), "__neg", [KSSeparation()], names)
    return ic.join(ks, "feature").orderBy(F.abs("spearman_ic").desc_nulls_last(), "feature")


__all__ = ["FeatureAnalyzer", "KSSeparation", "MutualInfo", "SpearmanIC", "TreeR2", "analyze_features", "rank_features", "unpivot"]
