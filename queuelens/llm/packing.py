"""Packing documents into sequences: shortest-pack-first over the length histogram.

Pieces
    Every document is encoded, gets the end id, and is cut into pieces of ``length`` ids and a rest. Pieces are
    stored with their ids in the work folder, numbered by task (``part``) and, per length, within the task (``nth``).

Plan
    The histogram of piece lengths (``length`` rows at most) goes to the driver. Lengths are placed longest first,
    each into the pack with the fewest ids so far if it fits, else into new packs. All packs of one pattern of lengths
    move together, and a length splits one pattern at most, so there are never more patterns than lengths, and a
    pattern has fewer than sqrt(2 * length) different lengths.

Assignment
    Pieces of one length are interchangeable. A piece's rank among them is its ``nth`` plus the counts of the tasks
    before it; patterns claim ranges of ranks, and the range that holds a piece's rank gives its sequence and offset.
    The table of ranges is bounded by the plan (see above) and is broadcast.

Edge cases: a null text is empty and has the end id only; null and repeated ids and repeated rows are packed row by
row; an empty table has no pieces; texts of any length are cut, never shortened.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import Encoder
from .common import slices, write_table
from .tokenfile import crc32_of, token_lists


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int, length: int = 2048, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """(part, piece_id, nth, id, start, length, doc_tokens, tokens): the stored pieces of all documents."""
    narrow = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    id_type = narrow.schema["id"].dataType.simpleString()
    names = ["part", "piece_id", "nth", "id", "start", "length", "doc_tokens", "tokens"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = Encoder.of(tokenizer), end_id.to_bytes(4, "little")
        part, made, seen = TaskContext.get().partitionId(), 0, np.zeros(length + 1, np.int64)
        for batch in slices(batches, "text", 2 << 20):
            ids, rows = [], []
            for row, x in enumerate(encoder.encode(batch.column("text").to_pylist())):
                x += end
                n = len(x) // 4
                for start in range(0, n, length):
                    size = min(length, n - start)
                    ids.append(x[4 * start:4 * (start + size)])
                    rows.append((made, seen[size], row, start, size, n))
                    made += 1
                    seen[size] += 1
            made_, nth, row, start, size, n = np.array(rows, np.int64).T
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * len(rows), pa.int32()), pa.array((part << 40) + made_), pa.array(nth),
                 batch.column("id").take(pa.array(row)), pa.array(start), pa.array(size), pa.array(n),
                 token_lists(ids)], names=names)

    rows = narrow.mapInArrow(cut, f"part int, piece_id bigint, nth bigint, id {id_type}, start bigint, length bigint, "
                                  "doc_tokens bigint, tokens array<int>")
    path = write_table(rows, "pieces", {"compression": "zstd"})
    return docs.sparkSession.read.schema(rows.schema).parquet(path)


def plan(histogram: dict[int, int], length: int) -> list[tuple[list[tuple[int, int]], int]]:
    """[(pattern, packs)]: pattern is [(piece length, how many)], longest first; see the module text."""
    open_packs: list[tuple[int, int, int, tuple | None]] = []  # ids, tie-break, packs, linked pattern
    tick = 0

    def push(size: int, packs: int, pattern: tuple) -> None:
        nonlocal tick
        tick += 1
        heapq.heappush(open_packs, (size, tick, packs, pattern))

    for piece in sorted(histogram, reverse=True):
        left = histogram[piece]
        while left:
            if not open_packs or open_packs[0][0] + piece > length:
                push(piece, left, (None, piece, 1))
                left = 0
                continue
            size, _, packs, pattern = heapq.heappop(open_packs)
            taken = min(left, packs)
            if taken < packs:
                push(size, packs - taken, pattern)
            grown = (pattern[0], piece, pattern[2] + 1) if pattern[1] == piece else (pattern, piece, 1)
            push(size + piece, taken, grown)
            left -= taken
    out = []
    for _, _, packs, pattern in sorted(open_packs, key=lambda x: x[1]):
        items = []
        while pattern is not None:
            items.append((pattern[1], pattern[2]))
            pattern = pattern[0]
        out.append((items[::-1], packs))
    return out


def rank_ranges(patterns: list[tuple[list[tuple[int, int]], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, pieces per sequence, offset) for every pattern and length."""
    rows, used, sequence = [], {}, 0
    for items, packs in patterns:
        offset = 0
        for piece, times in items:
            first = used.get(piece, 0)
            used[piece] = first + packs * times
            rows.append((piece, first, used[piece], sequence, times, offset))
            offset += piece * times
        sequence += packs
    return rows


def pack(pieces: DataFrame, length: int = 2048) -> DataFrame:
    """(piece_id, sequence_id, offset) for every stored piece."""
    spark = pieces.sparkSession
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    histogram = dict(counts.groupBy("length").agg(F.sum("n")).collect())  # at most ``length`` rows
    ranges = spark.createDataFrame(
        rank_ranges(plan(histogram, length)),
        "length bigint, first bigint, stop bigint, sequence bigint, times bigint, at bigint")
    ranked = pieces.select("piece_id", "part", "length", "nth").join(bases, ["part", "length"]).select(
        "piece_id", "length", (F.col("base") + F.col("nth")).alias("rank"))
    r, s = ranked.alias("r"), F.broadcast(ranges).alias("s")
    inside = (F.col("r.length") == F.col("s.length")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("stop"))
    nth = F.col("rank") - F.col("first")
    return r.join(s, inside).select(
        "piece_id", (F.col("sequence") + F.expr("(rank - first) DIV times")).alias("sequence_id"),
        (F.col("at") + nth % F.col("times") * F.col("r.length")).alias("offset"))


def checksums(pieces: DataFrame) -> DataFrame:
    """The pieces with ``ids_crc32`` in place of their ids."""
    narrow = pieces.select("piece_id", "id", "start", "length", "doc_tokens", "tokens")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], crc32_of(batch.column(5))],
                                             names=["piece_id", "id", "start", "length", "doc_tokens", "ids_crc32"])

    id_type = narrow.schema["id"].dataType.simpleString()
    return narrow.mapInArrow(sums, f"piece_id bigint, id {id_type}, start bigint, length bigint, doc_tokens bigint, "
                                   "ids_crc32 bigint")


def packed(docs: DataFrame, tokenizer: str, end_id: int, length: int = 2048, id_col: str = "doc_id",
           text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(pieces with their ids, assignment of each piece_id to a sequence and offset)."""
    pieces = cut_pieces(docs, tokenizer, end_id, length, id_col, text_col)
    return pieces, pack(pieces, length)


def sequences(pieces: DataFrame, assignment: DataFrame) -> DataFrame:
    """(sequence_id, tokens): every sequence's ids in order (at most ``length`` ids each)."""
    held = pieces.join(assignment, "piece_id").groupBy("sequence_id").agg(
        F.array_sort(F.collect_list(F.struct("offset", "tokens"))).alias("held"))
    return held.select("sequence_id", F.flatten(F.transform("held", lambda x: x.tokens)).alias("tokens"))
