"""The queries of the corpus operators, for the driver."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from tidemark.llm import decontamination, embedding_dedup, language_id, line_dedup, mixing, ngram_join, secret_scan, substring_dedup, suffix_dedup, toxicity
from tidemark.llm.oracle import ORACLE

QUERIES = {
    "op1_secret_scan": secret_scan.query,
    "op2_language_id": language_id.query,
    "op3_embedding_dedup": embedding_dedup.query,
    "op4_substring_dedup": substring_dedup.query,
    "op5_toxicity": toxicity.query,
    "op6_line_dedup": line_dedup.query,
    "op7_mixing": mixing.query,
    "op8_ngram_join": ngram_join.query,
    "op9_decontamination": decontamination.query,
    "op10_suffix_dedup": suffix_dedup.query,
    "pipeline": corpus_pipeline.run,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
