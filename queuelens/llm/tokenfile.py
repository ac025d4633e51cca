"""Token-id files: Parquet list columns with controlled encodings, row groups and page indexes.

Format
    One row per document in ascending id order, within and across the files: ``part`` (number of the file in that
    order), the id, ``local_start`` (ids of the documents before it in its file), ``n_tokens`` and ``tokens``.
    ``tokens`` is dictionary encoded (a vocabulary fits a dictionary page), the numbers are delta encoded, row groups
    hold ``group_bytes``, pages ``page_rows`` rows, and the page index carries each page's smallest and largest
    value. A reader of some ids or of the numbers alone therefore touches only their pages and columns.

Writing ranges the documents by id (and by a hash of the text where ids repeat), so one shuffle of the texts sorts
them, and encodes inside the sorted partitions. ``starts`` gives global positions from the files: the totals of the
parts, one row per file, are summed up and joined to the rows.

Edge cases: a null text is empty and has the end id only; null ids come first; repeated rows are kept, in the order
of their text's hash; an empty table gives files without rows. Further columns are not stored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from queuelens.session import scratch_dir

from .bpe import Encoder
from .common import slices


def token_lists(ids: list[bytes]) -> pa.ListArray:
    """Little-endian 32-bit ids as a list column."""
    ends = np.cumsum([0] + [len(x) // 4 for x in ids])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<i4")))


def crc32_of(tokens: pa.ListArray) -> pa.Array:
    """Unsigned crc32 of each list's ids as little-endian 32-bit integers."""
    values, ends = tokens.values.to_numpy(zero_copy_only=False).astype("<i4"), tokens.offsets.to_numpy()
    return pa.array([zlib.crc32(values[a:b]) for a, b in zip(ends[:-1], ends[1:])], pa.int64())


def encoding_options(group_bytes: int, page_rows: int, numbers: list[str]) -> dict[str, str]:
    options = {"compression": "zstd", "parquet.writer.version": "PARQUET_2_0",
               "parquet.block.size": str(group_bytes), "parquet.page.row.count.limit": str(page_rows),
               "parquet.dictionary.page.size": str(1 << 20), "parquet.enable.dictionary": "true"}
    return options | {f"parquet.enable.dictionary#{name}": "false" for name in numbers}


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text",
                 path: str | None = None, group_bytes: int = 32 << 20, page_rows: int = 2000) -> str:
    """Encode ``docs`` into token-id files and return their path (a new one in the work folder by default)."""
    path = path or scratch_dir(docs.sparkSession, "tokens")
    tie = F.xxhash64(F.col(text_col))
    ordered = (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("tie", tie)
               .repartitionByRange("id", "tie").sortWithinPartitions("id", "tie").select("id", "text"))
    id_type = ordered.schema["id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = Encoder.of(tokenizer), end_id.to_bytes(4, "little")
        part, before = TaskContext.get().partitionId(), 0
        for batch in slices(batches, "text", 2 << 20):
            ids = [x + end for x in encoder.encode(batch.column("text").to_pylist())]
            n = np.array([len(x) // 4 for x in ids], np.int64)
            starts = before + np.cumsum(n) - n
            before += int(n.sum())
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * len(ids), pa.int32()), batch.column("id"), pa.array(starts), pa.array(n),
                 token_lists(ids)], names=["part", id_col, "local_start", "n_tokens", "tokens"])

    rows = ordered.mapInArrow(
        encode, f"part int, `{id_col}` {id_type}, local_start bigint, n_tokens bigint, tokens array<int>")
    numbers = ["part", id_col, "local_start", "n_tokens"]
    rows.write.options(**encoding_options(group_bytes, page_rows, numbers)).parquet(path)
    return path


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows; select columns and filter by id to read only their pages."""
    return spark.read.parquet(path)


def starts(rows: DataFrame, files: DataFrame) -> DataFrame:
    """``rows`` of ``files`` with ``start``, the ids of all documents before."""
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("held"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    bases = totals.select("part", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("base"))
    return rows.join(bases, "part").withColumn("start", F.col("base") + F.col("local_start")).drop("base")


def checksums(files: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Files' rows with ``ids_crc32`` in place of the tokens."""
    narrow = files.select("part", id_col, "local_start", "n_tokens", "tokens")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], crc32_of(batch.column(4))],
                                             names=["part", id_col, "local_start", "n_tokens", "ids_crc32"])

    id_type = narrow.schema[id_col].dataType.simpleString()
    return narrow.mapInArrow(sums, f"part int, `{id_col}` {id_type}, local_start bigint, n_tokens bigint, ids_crc32 bigint")
