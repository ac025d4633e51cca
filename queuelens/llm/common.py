"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from queuelens.session import scratch_dir

#: Words of the contracts: runs without ASCII white space.
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def write_table(df: DataFrame, label: str, options: dict[str, str] | None = None) -> str:
    """Write a frame below the shared work folder and return the path."""
    path = scratch_dir(df.sparkSession, label)
    df.write.options(**(options or {})).parquet(path)
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage with a table in the shared work folder (survives lost executors)."""
    return df.sparkSession.read.schema(df.schema).parquet(write_table(df, label))


def text_of(value: str | None) -> str:
    return "" if value is None else value


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the texts of a slice hold about ``most_bytes``; a longer text stands alone."""
    for batch in batches:
        texts = batch.column(column)
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
        start = held = 0
        for row, size in enumerate(sizes):
            if row > start and held + size > most_bytes:
                yield batch.slice(start, row - start)
                start, held = row, 0
            held += size
        if len(sizes) > start:
            yield batch.slice(start)


def whole_rows(docs: DataFrame, *inputs: str) -> DataFrame:
    """All columns as one struct ``row``, beside the named input columns as ``in_<name>``; no name can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       *[F.col(f"`{c}`").alias(f"in_{c}") for c in inputs])
