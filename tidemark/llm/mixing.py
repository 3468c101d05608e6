"""Mixing sources to target weights as a time-varying curriculum.

Targets: sources share the words of the mix by weight, each up to a multiple of its own size, and the
excess of capped ones is shared again (water filling, in closed form over the sources sorted by cap
over weight). Curriculum: a source's weight changes along training as a piecewise linear schedule. Its
integral is the source's cumulative demand for words; a document whose words begin at offset y of its
source's order is needed when the demand reaches y, so its position is the inverse at y. Documents are
then range-sorted by position.

Inside a source the order is by a hash of doc_id. Offsets come from sums per (source, slice of the
hash) and a window inside each slice, so a source with most of the rows is many small tasks.

Edge cases: NULL, empty and blank texts have size 0 and give no words; a NULL source is one source,
the last; rows without doc_id and repeated rows count like others; reruns agree.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import common as C

#: Weights of sources by rank, in turn, and how each one's weight moves from the first to the last word.
WEIGHTS = (5.0, 2.0, 1.0)
SCHEDULES = ((1.5, 1.0, 0.5), (1.0, 1.0, 1.0), (0.5, 1.0, 1.5))
#: Documents in a slice of a source's order, about.
SLICE = 2000


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """source, skey, source_size, rank, target from (source, skey, source_size): a row per source."""
    one = Window.partitionBy()
    d = sizes.withColumn("rank", F.row_number().over(one.orderBy(F.col("source").isNull(), "source")) - 1)
    w = F.lit(float(weights[-1]))
    for i, x in enumerate(weights[:-1]):
        w = F.when(F.pmod("rank", F.lit(len(weights))) == i, float(x)).otherwise(w)
    d = d.withColumn("w", w).withColumn("most", F.col("source_size") * cap).withColumn("full", F.col("most") / F.col("w"))
    order = one.orderBy("full", "rank")
    before = F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    d = d.withColumn("level", (F.sum("source_size").over(one) * share - before) / rest)
    # the level of the first source, by cap over weight, that it doesn't fill
    d = d.withColumn("level", F.min_by(F.when(F.col("level") <= F.col("full"), F.col("level")), F.when(F.col("level") <= F.col("full"), F.struct("full", "rank"))).over(one))
    return d.select("source", "skey", "source_size", "rank", F.coalesce(F.least("most", F.col("level") * F.col("w")), "most").alias("target"))


def demand_inverse(y: Column, knots: Sequence[float]) -> Column:
    """The time in [0, 1] at which the demand of a schedule with these weights at equal steps is the
    share y of its whole."""
    n = len(knots) - 1
    area = [(a + b) / 2 / n for a, b in zip(knots, knots[1:], strict=False)]
    out: Column | None = None
    for j in reversed(range(n)):
        a, b = knots[j] / sum(area), knots[j + 1] / sum(area)
        from_ = sum(area[:j]) / sum(area)
        s = (y - F.lit(from_)) * n
        root = F.sqrt(F.greatest(F.lit(a * a) + s * (2 * (b - a)), F.lit(0.0)))
        t = F.lit(j / n) + F.try_divide(s * 2, F.lit(a) + root) / n
        out = t if out is None else F.when(y < F.lit(from_ + area[j] / sum(area)), t).otherwise(out)
    return F.least(F.greatest(out, F.lit(0.0)), F.lit(1.0))


def sized(docs: DataFrame, pattern: str = r"[^\x20\x09-\x0D]+") -> DataFrame:
    """doc_id, source, size and h, the hash that orders a source: of doc_id, or of the text without one, so
    that rows without doc_id are not of one hash."""
    size = F.coalesce(F.regexp_count("text", F.lit(pattern)), F.lit(0)).cast("long")
    return docs.select("doc_id", "source", size.alias("size"), F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id")).alias("h"))


def curriculum(docs: DataFrame, weights: Sequence[float] = WEIGHTS, schedules: Sequence[Sequence[float]] = SCHEDULES, share: float = 1.5, cap: int = 2) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (words the mix takes, repeats counted), and
    passes: array of (position in [0, 1], words) of each pass over the document that the mix makes.
    Sorted by first position, over ranges of it; what is not taken comes last."""
    base = sized(docs).select("*", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("skey"))
    base = C.written(base, "mix-sizes")
    bits = max(4, min(20, math.ceil(math.log2(base.count() / SLICE + 1))))
    base = base.withColumn("slice", F.shiftright("h", 64 - bits))
    per = C.written(base.groupBy("source", "skey", "slice").agg(F.sum("size").alias("n")), "mix-slices")
    src = C.written(targets(per.groupBy("source", "skey").agg(F.sum("n").alias("source_size")), weights, share, float(cap)), "mix-targets").drop("source")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("skey").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    off = per.select("skey", "slice", before.alias("from")).join(src, "skey")
    inside = Window.partitionBy("skey", "slice").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    d = base.withColumn("at", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(off, ["skey", "slice"])
    y, whole = F.col("from") + F.col("at"), F.round("target").cast("long")
    kind = F.pmod("rank", F.lit(len(weights)))

    def one(k: int) -> Column:
        start = y + F.col("source_size") * k
        words = F.greatest(F.least(whole - start, "size"), F.lit(0))
        at = F.try_divide(start, F.col("target"))
        t = demand_inverse(at, schedules[-1])
        for i, s in enumerate(schedules[:-1]):
            t = F.when(kind == i, demand_inverse(at, s)).otherwise(t)
        return F.struct(t.alias("position"), words.cast("long").alias("words"))

    d = d.withColumn("passes", F.filter(F.array(*[one(k) for k in range(cap)]), lambda p: p["words"] > 0))
    d = d.withColumn("taken", F.aggregate("passes", F.lit(0).cast("long"), lambda acc, p: acc + p["words"]))
    d = C.written(d.select("doc_id", "source", "size", "source_size", "target", "taken", "passes", "h"), "mix-positions")
    # rows that are not taken are spread over ranges of their own
    d = d.withColumn("by", F.coalesce(F.get("passes", F.lit(0))["position"], F.lit(1.5) + F.col("h") / 2.0**64))
    return d.repartitionByRange(C.partitions(d), "by", "doc_id").sortWithinPartitions("by", "doc_id").drop("by", "h")


def query(spark, sf_dir: str) -> DataFrame:
    d = curriculum(C.documents(spark, sf_dir))
    return d.select("doc_id", "size", "source_size", "target", "taken", F.get("passes", F.lit(0))["position"].alias("position"))
