"""Names to queries and to their checking SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from workload.derived import cte

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, tables: str = ""):
    """Registers a query; ``tables`` names the derived tables its SQL reads."""
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = cte(*tables.split()) + sql
        return fn
    return add
