"""The corpus pipeline: five stages, each written and read again as the next one's documents.

All stages: other columns pass through, and columns of theirs with the operators' names are not
touched; an empty table gives an empty one; equal rows are rows like others. What each does with NULLs and ties
is in its docstring; the operators' modules have the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common as C
from tidemark.llm import decontamination, language_id, line_dedup, mixing, ngram_join

#: Of an even share of all languages' counts, what a document's best language must exceed: text that
#: is as much of one language as of any other is of none.
LEAST_OVER_EVEN = 1.1
#: Of the part of its n-grams that a learned language knows of nearly all its own texts, what a document
#: must reach: text of which any language knows little is of none.
LEAST_OF_USUAL = 0.5


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs whose doc_id is not among ids; few ids are broadcast, by a count."""
    ids = C.written(ids.where("doc_id IS NOT NULL").distinct(), "without")
    few = ids.limit(ngram_join.BROADCAST_IDS + 1).count() <= ngram_join.BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_anti").select(*docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects NULL texts, texts without a letter, and texts of no language: with no language well ahead of
    the others, or that the best one hardly knows. Both are learned from all labelled rows. NULL labels teach nothing, and without any label
    nothing is kept; of languages that tie, the first counts."""
    model = language_id.train(docs.select("doc_id", "text", "lang"))
    known = LEAST_OF_USUAL * language_id.usual(docs.select("text", "lang"), model)
    names = ("__lang", "__score", "__known")
    p = language_id.predict(docs, model, names)
    least = LEAST_OVER_EVEN / len(model.langs) if len(model.langs) > 1 else 0.0
    ok = (F.col("__lang") != language_id.UNDETERMINED) & (F.col("__score") > least) & (F.col("__known") >= known)
    return p.where(ok).select(*docs.columns)


def line(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out lines that repeat an earlier one, by (doc_id, line number), within two edits, and documents
    left without a word. NULL texts and rows without doc_id stay as they are; n_chars follows the text."""
    d = line_dedup.dedup_lines(docs, **line_dedup.ALL_LINES)
    return d.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else d


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, the smallest doc_id, of each group of near copies. NULL and empty texts and
    rows without doc_id stay; rows that repeat a doc_id stay or go together."""
    return without(docs, ngram_join.ngram_join(docs).where("component_id <> doc_id").select("doc_id"))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of the benchmark, by doc_id; NULL texts and rows without doc_id
    stay."""
    return without(docs, decontamination.contaminated(docs, C.table(spark, sf_dir, "benchmark")).select("doc_id"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The curriculum: a row for each document that the mix takes, in the order of training. Texts without a
    word are not taken; NULL sources are one source; the order of a source is by a hash, then doc_id."""
    return mixing.curriculum(docs).where("taken > 0")


STAGES = [("language ID", language), ("line dedup", line), ("n-gram Jaccard join", near), ("benchmark decontamination", benchmark), ("mixing sources to target weights", mix)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = C.written(stage(spark, docs, sf_dir), "stage-" + name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)
