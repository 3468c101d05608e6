"""Secret scans with an incremental blob ledger, in DataFrame functions only.

Every version of a path is addressed by the SHA-256 of its content. The ledger (Parquet, in the shared
folder) says which blobs were scanned under which version of which rule. A run scans only the pairs
that the ledger lacks, each blob once however many paths hold it, appends what it found, and joins
findings back to all paths. A changed rule has a new version, and only it is run again.

Offsets without a UDF: the text split by a pattern, and the pattern's matches, alternate; the running
sum of their lengths in characters gives each match's start.

Edge cases: NULL and empty texts have no findings; paths may repeat, be NULL or share blobs; every row
given is returned; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common as C


@dataclass(frozen=True)
class Rule:
    """pattern: Java's syntax, never matching the empty string. A match counts if its ``group`` has
    least characters. hint: a cheaper pattern found in every text that has a match."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    hint: str = ""
    version: int = 1


#: The base rules, in the order of their kinds.
BASE_RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, r"(?i)(?:passw(?:or)?d|secret|token|api_?key)"),
    # a run that is too short is part of no longer one, so the least length can be in the pattern
    Rule("access", r"AKIA[A-Z0-9]{16,}", hint="AKIA[A-Z0-9]{16}"),
    Rule("hex", r"[0-9a-f]{24,}", hint="[0-9a-f]{24}"),
)
SPAN = "array<struct<start:int,end:int>>"


def spans(text: Column, rule: Rule) -> Column:
    """The rule's matches as an array of (start, end), in characters, end exclusive."""
    found, value, between = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)), F.split(text, rule.pattern, -1)
    parts = F.arrays_zip(found.alias("m"), value.alias("v"), F.slice(between, F.lit(1), F.size(found)).alias("b"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["b"])
        end = start + F.length(x["m"])
        one = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(F.length(x["v"]) >= rule.least, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    all_ = F.aggregate(parts, zero, step, lambda acc: acc["out"])
    return F.when(text.rlike(rule.hint), all_).otherwise(F.array().cast(SPAN)) if rule.hint else all_


class BlobLedger:
    """scanned (blob, kind, version) and findings (blob, kind, version, start, end) below a path."""

    SCANNED, FINDINGS = "blob string, kind string, version int", "blob string, kind string, version int, start int, end int"

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def scanned(self) -> DataFrame:
        return self._read("scanned", self.SCANNED)

    def findings(self) -> DataFrame:
        return self._read("findings", self.FINDINGS)

    def append(self, findings: DataFrame, scanned: DataFrame) -> None:
        """Findings first: a run that is lost between the two repeats its pairs, and readers drop repeats."""
        findings.write.mode("append").parquet(f"{self.path}/findings")
        scanned.write.mode("append").parquet(f"{self.path}/scanned")


def unseen(versions: DataFrame, ledger: BlobLedger, rules: Sequence[Rule]) -> DataFrame:
    """blob, path (one that holds it), kinds: what the ledger lacks. versions: path, blob."""
    one = versions.where("blob IS NOT NULL").groupBy("blob").agg(F.min("path").alias("path"))
    every = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])
    pairs = one.select("blob", "path", F.inline(every)).join(ledger.scanned(), ["blob", "kind", "version"], "left_anti")
    return pairs.groupBy("blob").agg(F.min("path").alias("path"), F.collect_set("kind").alias("kinds"))


def scan_versions(versions: DataFrame, ledger: BlobLedger, rules: Sequence[Rule] = BASE_RULES) -> DataFrame:
    """path, blob, spans: array of (start, rank of the rule, kind, end) for each row of versions (path,
    text), after a scan of what is new."""
    addressed = versions.select("path", F.sha2(F.col("text").cast("binary"), 256).alias("blob"), "text")
    paths = C.written(addressed.select("path", "blob"), "secret-paths")
    todo = C.written(unseen(paths, ledger, rules), "secret-todo")
    t = todo.select(F.col("blob").alias("b"), F.col("path").alias("p"), "kinds").hint("shuffle_hash")
    new = addressed.where("blob IS NOT NULL").join(t, F.expr("blob = b AND path <=> p"))
    each = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), F.when(F.array_contains("kinds", r.kind), spans(F.col("text"), r)).alias("found")) for r in rules])
    found = new.select("blob", F.inline(each)).where(F.size("found") > 0).select("blob", "kind", "version", F.inline("found"))
    version = F.create_map(*[x for r in rules for x in (F.lit(r.kind), F.lit(r.version))])
    ledger.append(found, todo.select("blob", F.explode("kinds").alias("kind")).withColumn("version", version[F.col("kind")]).select("blob", "kind", "version"))

    rank = F.array_position(F.array(*[F.lit(r.kind) for r in rules]), F.col("kind"))
    now = ledger.findings().where(version[F.col("kind")] == F.col("version")).dropDuplicates()
    per = now.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("start", rank.alias("rank"), "kind", "end"))).alias("spans"))
    empty = F.array().cast("array<struct<start:int,rank:bigint,kind:string,end:int>>")
    return paths.join(per, "blob", "left").select("path", "blob", F.coalesce("spans", empty).alias("spans"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger of this run's own, so that every blob is new."""
    d = C.documents(spark, sf_dir).select(F.col("doc_id").alias("path"), "text")
    s = scan_versions(d, BlobLedger(spark, C.scratch(spark, "secret-ledger")))
    text = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    n = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return s.select(F.col("path").alias("doc_id"), n("assign"), n("access"), n("hex"), F.sha2(text.cast("binary"), 256).alias("base_sha256"), text.alias("spans"))
