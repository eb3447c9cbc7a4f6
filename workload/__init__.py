"""Registered queries: every operator over tables derived from the given ones, with the SQL
that checks it."""

from workload.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "load_all"]


def load_all() -> None:
    from workload import (  # noqa: F401
        aggregates, composites, filters, joins, large, readers, scalars, sources, store, streams, text, windows,
    )
