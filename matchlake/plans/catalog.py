"""Registry of the queries: name → (Spark query, SQL answer or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ANSWERS: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a Spark query under its operator name."""
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ANSWERS[name] = sql
        return fn
    return register


def load() -> None:
    """Import every module that registers queries."""
    from matchlake.plans import (queries_analytics, queries_documents,  # noqa: F401
                                 queries_ingest, queries_matching, queries_signals)
