"""Registered queries over the driver tables, each with its SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def registry() -> dict[str, tuple[Query, str | None]]:
    """Query name -> (Spark callable, DuckDB SQL or None)."""
    from . import analytics, filters, history, ingest, layouts, profiling, records, streams
    merged: dict[str, tuple[Query, str | None]] = {}
    for module in (analytics, filters, history, records, ingest, profiling, streams, layouts):
        overlap = merged.keys() & module.QUERIES.keys()
        if overlap:
            raise ValueError(f"query names used twice: {sorted(overlap)}")
        merged.update(module.QUERIES)
    return merged
