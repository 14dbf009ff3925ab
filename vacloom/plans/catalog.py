"""Registry of queries and of the SQL each is compared with."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = function
        if sql is not None:
            ORACLE[name] = sql
        return function

    return add


MODULES = [
    "search_queries", "movement_queries", "score_queries", "snapshot_queries", "feed_queries",
    "matching_queries", "refresh_queries", "text_queries", "page_queries",
    "registry_queries", "discovery_queries", "audit_queries", "coverage_queries",
    "signal_queries", "phrase_queries", "stream_queries", "payload_queries", "career_queries",
]


def load_all() -> None:
    """Import every module that registers queries."""
    for name in MODULES:
        import_module(f"{__package__}.{name}")
