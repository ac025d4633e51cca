"""Ownership figures kept up to date by a stream of events.

Three keyed stores: the events by (request, segment of time), one mergeable summary per (request, segment), and the figures
per request. A batch folds again only the segments that its events fall into, from those segments' stored events,
so late and out-of-order events need no special case; the other segments of a request count by their summaries, which are
merged in order. Lookups skip the pages of other requests, so what a batch reads depends on the batch and not on the history.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..operators.history import ownership_figures, segment_summaries, with_segment
from ..sources.runs import KeyedStore

SEGMENT_DAYS = 30.0
EVENT_FIELDS = ("request", "segment", "ts", "seq", "state", "actor")


def event_store(base: str, events: T.StructType) -> KeyedStore:
    """Events by (request, segment); ``events`` is the schema of a batch."""
    types = {f.name: f.dataType for f in events.fields} | {"segment": T.LongType()}
    return KeyedStore(f"{base}/events", T.StructType([T.StructField(c, types[c]) for c in EVENT_FIELDS]), ("request", "segment"))


def summary_store(base: str, summaries: T.StructType) -> KeyedStore:
    return KeyedStore(f"{base}/summaries", summaries, ("request",), ("request", "segment"))


def figure_store(base: str, figures: T.StructType) -> KeyedStore:
    return KeyedStore(f"{base}/ownership", figures, ("request",))


def _stores(spark: SparkSession, base: str, events: T.StructType) -> tuple[KeyedStore, KeyedStore, KeyedStore]:
    """The three stores; the schemas follow from that of the events."""
    none = spark.createDataFrame([], events)
    summaries = segment_summaries(none, SEGMENT_DAYS)
    return (event_store(base, events), summary_store(base, summaries.schema),
            figure_store(base, ownership_figures(summaries, "segment", "1970-01-01").schema))


def update(batch: DataFrame, batch_id: int, base: str, as_of, segment_days: float = SEGMENT_DAYS) -> None:
    """Add a batch of events and bring the figures of its requests up to date; writing a batch again is harmless.

    All batches of a store must use the same ``segment_days``.
    """
    spark = batch.sparkSession
    events = with_segment(batch, segment_days).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        history, summaries, figures = _stores(spark, base, batch.schema)
        history.append(events, batch_id)
        touched = events.select("request", "segment").distinct()
        summaries.append(segment_summaries(history.read(spark, touched), segment_days), batch_id)
        known = summaries.current(spark, touched.select("request").distinct())
        figures.append(ownership_figures(known, "segment", as_of), batch_id)
    finally:
        events.unpersist()


def maintain(spark: SparkSession, base: str, events: T.StructType, most_runs: int = 4) -> None:
    """Merge small runs of the stores; run it every few batches, between them."""
    history, summaries, figures = _stores(spark, base, events)
    history.compact(spark, most_runs, keep_all=True)
    summaries.compact(spark, most_runs)
    figures.compact(spark, most_runs)


def current(spark: SparkSession, base: str, events: T.StructType) -> DataFrame:
    """The newest figures per request."""
    return _stores(spark, base, events)[2].current(spark).drop("batch_id")
