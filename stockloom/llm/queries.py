"""Importing this module registers every corpus query."""

from stockloom.llm import queries_rows, queries_spans, queries_text, queries_words  # noqa: F401
from stockloom.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
