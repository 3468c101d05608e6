"""The corpus pipeline for the driver; its stages are in tidemark.llm.pipeline."""

from tidemark.llm.pipeline import STAGES, run

#: The stages' learned and iterative parts have no SQL; tests compare them with brute force.
ORACLE_SQL = None

__all__ = ["ORACLE_SQL", "STAGES", "run"]
