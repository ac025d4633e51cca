"""Keyed store: runs of rows sorted by key hash, listed in a manifest.

A batch leaves one run, cut into buckets by the hash of its key and sorted by that hash within them; its row in the manifest
is written last and makes it live. A read opens the live runs only, of the asked buckets only, and where keys are given, the
pages of a file whose hash range they meet (the Parquet page index). The newest version of a key wins on reading.
``compact`` merges the runs of a bucket once they are too many: neighbours of like size first, so that a row is
rewritten a logarithmic number of times and a bucket never has more than about ``most_runs`` runs per size class.

The manifest also holds, per group of a batch (a list of requests, say), the number of rows, the range of the hashes and the
highest stamp: questions about the state of the store open no data file.

Every try of a batch writes files of its own, and its manifest entry, one small file, switches to them at once. A crash before
that leaves the last good state and files that nobody reads (``vacuum`` removes them). An entry that a compaction has taken up
stays replaced: writing that batch again changes nothing.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..operators.dedup import latest_per_key
from .files import delete, exists, list_folders

MANIFEST = ("entry STRING, run STRING, batch_id BIGINT, bucket INT, grp STRING, n_rows BIGINT, low BIGINT, high BIGINT, max_stamp BIGINT, "
            "replaces ARRAY<STRING>")
#: Ranges of hashes that a lookup asks the files for, at most.
MOST_RANGES = 512
#: Rows of a page; a lookup reads one page of each column per key and file.
PAGE_ROWS = 2000
HASH, BUCKET = "__h", "__bucket"


def _any_of(conditions: Sequence[Column]) -> Column:
    """A balanced tree of ORs; a chain of hundreds would be too deep."""
    if len(conditions) == 1:
        return conditions[0]
    half = len(conditions) // 2
    return _any_of(conditions[:half]) | _any_of(conditions[half:])


@dataclass(frozen=True)
class KeyedStore:
    """A store below ``path`` of rows of ``schema`` found by ``key``.

    ``version`` (by default the key) names the columns of which the newest row counts, ``newest`` the order among them
    (by default the newest batch), ``group`` and ``stamp`` what the manifest keeps figures of.
    """

    path: str
    schema: T.StructType
    key: tuple[str, ...]
    version: tuple[str, ...] = ()
    newest: tuple[str, ...] = ("batch_id",)
    group: str | None = None
    stamp: str | None = None
    buckets: int = 8

    # --- manifest ---------------------------------------------------------------------

    def manifest(self, spark: SparkSession) -> DataFrame:
        """One row per (run, bucket, group)."""
        path = f"{self.path}/manifest"
        return spark.read.schema(MANIFEST).parquet(path) if exists(spark, path) else spark.createDataFrame([], MANIFEST)

    def live(self, spark: SparkSession) -> dict[int, dict[str, tuple[str, int]]]:
        """Per bucket the entries to read with their run and its rows; metadata of at most runs times buckets."""
        rows = self.manifest(spark).where("n_rows > 0 OR size(replaces) > 0").groupBy("entry", "run", "bucket").agg(
            F.sum("n_rows").alias("n_rows"), F.first("replaces").alias("replaces")).collect()
        gone = {(r.bucket, name) for r in rows for name in r.replaces}
        found: dict[int, dict[str, tuple[str, int]]] = defaultdict(dict)
        for r in rows:
            if (r.bucket, r.entry) not in gone and r.n_rows:
                found[r.bucket][r.entry] = (r.run, r.n_rows)
        return found

    def figures(self, spark: SparkSession) -> DataFrame:
        """(grp, max_stamp, last_batch) from the manifest alone."""
        return self.manifest(spark).where("n_rows > 0").groupBy("grp").agg(
            F.coalesce(F.max("max_stamp"), F.lit(0)).alias("max_stamp"), F.max("batch_id").alias("last_batch"))

    # --- writing ----------------------------------------------------------------------

    def hash_of(self) -> Column:
        return F.xxhash64(*self.key)

    def append(self, df: DataFrame, batch_id: int) -> None:
        """Write a batch as a run, then its manifest entry."""
        self._write(df.withColumn("batch_id", F.lit(batch_id).cast("bigint")), f"b{batch_id}", {})

    def _write(self, df: DataFrame, entry: str, replaces: dict[int, list[str]]) -> None:
        spark, run = df.sparkSession, f"{entry}-{uuid.uuid4().hex}"
        target = f"{self.path}/runs/run={run}"
        names = [f.name for f in self.schema.fields]
        keyed = df.select(*names, "batch_id", self.hash_of().alias(HASH)).withColumn(
            BUCKET, F.pmod(HASH, F.lit(self.buckets)).cast("int"))
        # rebalance splits a bucket with very many rows and joins small ones
        (keyed.hint("rebalance", BUCKET).sortWithinPartitions(BUCKET, HASH).write
         .option("parquet.page.row.count.limit", PAGE_ROWS).partitionBy(BUCKET).parquet(target))
        self._enter(spark.read.schema(self._stored()).parquet(target), entry, run, replaces)

    def _enter(self, stored: DataFrame, entry: str, run: str, replaces: dict[int, list[str]]) -> None:
        """The manifest entry of a run, from what was stored; the figures of replaced entries live on in it."""
        spark = stored.sparkSession
        group = F.col(self.group).cast("string") if self.group else F.lit(None).cast("string")
        stamp = F.max(self.stamp) if self.stamp else F.lit(None)
        rows = stored.groupBy(F.col(BUCKET).alias("bucket"), group.alias("grp")).agg(
            F.count(F.lit(1)).alias("n_rows"), F.min(HASH).alias("low"), F.max(HASH).alias("high"),
            stamp.cast("bigint").alias("max_stamp"), F.max("batch_id").alias("batch_id"))
        none = F.array().cast("array<string>")
        if replaces:
            taken = spark.createDataFrame([(b, e) for b, entries in replaces.items() for e in entries], "bucket INT, entry STRING")
            old = self.manifest(spark).join(F.broadcast(taken), ["bucket", "entry"]).select(  # the entries of this call
                "bucket", "grp", F.lit(0).cast("bigint").alias("n_rows"), F.lit(None).cast("bigint").alias("low"),
                F.lit(None).cast("bigint").alias("high"), "max_stamp", "batch_id")
            rows = rows.unionByName(old).groupBy("bucket", "grp").agg(
                F.sum("n_rows").alias("n_rows"), *[f(c).alias(c) for f, c in (
                    (F.min, "low"), (F.max, "high"), (F.max, "max_stamp"), (F.max, "batch_id"))])
            none = F.create_map(*[x for b, entries in replaces.items() for x in (F.lit(b), F.array(*map(F.lit, entries)))])[F.col("bucket")]
        (rows.select(F.lit(entry).alias("entry"), F.lit(run).alias("run"), "batch_id", "bucket", "grp", "n_rows", "low", "high",
                     "max_stamp", none.alias("replaces")).coalesce(1).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("entry").parquet(f"{self.path}/manifest"))

    # --- reading ----------------------------------------------------------------------

    def _stored(self) -> T.StructType:
        return T.StructType([*self.schema.fields, T.StructField("batch_id", T.LongType()), T.StructField(HASH, T.LongType()),
                             T.StructField(BUCKET, T.IntegerType())])

    def _open(self, spark: SparkSession, runs: dict[int, list[str]]) -> DataFrame:
        paths = [f"{self.path}/runs/run={run}/{BUCKET}={bucket}" for bucket, names in runs.items() for run in names]
        if not paths:
            return spark.createDataFrame([], self._stored())
        return spark.read.schema(self._stored()).option("basePath", f"{self.path}/runs").parquet(*paths)

    def read(self, spark: SparkSession, keys: DataFrame | None = None) -> DataFrame:
        """Rows of all live versions, with ``batch_id``; with ``keys`` (the key columns) those keys' rows only.

        The keys' hashes are gathered to at most ``MOST_RANGES`` ranges, by which buckets, row groups and pages are
        skipped; an exact semi-join follows.
        """
        runs = {b: [run for run, _ in entries.values()] for b, entries in self.live(spark).items()}
        names = [f.name for f in self.schema.fields]
        if keys is None:
            return self._open(spark, runs).select(*names, "batch_id")
        wanted = keys.select(*self.key).distinct()
        h = wanted.select(self.hash_of().alias("h"))
        ranges = h.groupBy(F.shiftright("h", 64 - (MOST_RANGES.bit_length() - 1))).agg(
            F.min("h").alias("low"), F.max("h").alias("high"),
            F.collect_set(F.pmod("h", F.lit(self.buckets)).cast("int")).alias("buckets")).collect()  # MOST_RANGES rows
        if not ranges:
            return spark.createDataFrame([], self._stored()).select(*names, "batch_id")
        met = {b for r in ranges for b in r.buckets}
        rows = self._open(spark, {b: names for b, names in runs.items() if b in met}).where(
            _any_of([F.col(HASH).between(r.low, r.high) for r in ranges]))
        same = reduce(lambda a, b: a & b, [rows[k].eqNullSafe(wanted[k]) for k in self.key])
        return rows.join(wanted, same, "left_semi").select(*names, "batch_id")

    def current(self, spark: SparkSession, keys: DataFrame | None = None) -> DataFrame:
        """The newest row of each version."""
        return self._newest(self.read(spark, keys))

    def _newest(self, rows: DataFrame) -> DataFrame:
        return latest_per_key(rows, list(self.version or self.key), [F.desc(c) for c in self.newest])

    # --- upkeep -----------------------------------------------------------------------

    def compact(self, spark: SparkSession, most_runs: int = 4, keep_all: bool = False) -> list[int]:
        """Merge runs of the buckets that have more than ``most_runs`` of one size class; returns those buckets.

        Size classes are powers of ``most_runs``, so a row is rewritten once per class. ``keep_all`` keeps every row, for
        stores of events rather than of versions.
        """
        chosen: dict[int, list[str]] = {}
        open_runs: dict[int, list[str]] = {}
        for bucket, entries in self.live(spark).items():
            classes: dict[int, list[str]] = defaultdict(list)
            for entry, (_, rows) in entries.items():
                size = 0
                while most_runs ** (size + 1) <= rows:
                    size += 1
                classes[size].append(entry)
            merge: list[str] = []
            for size in sorted(classes):  # a merge of small ones may fill the next class
                if len(classes[size]) + bool(merge) > most_runs:
                    merge += classes[size]
            if len(merge) > 1:
                chosen[bucket], open_runs[bucket] = sorted(merge), [entries[e][0] for e in merge]
        if chosen:
            rows = self._open(spark, open_runs).select(*[f.name for f in self.schema.fields], "batch_id")
            self._write(rows if keep_all else self._newest(rows), f"c{uuid.uuid4().hex}", chosen)
        return sorted(chosen)

    def vacuum(self, spark: SparkSession) -> int:
        """Delete files that no live entry names; call it when no reader or writer is at work.

        Manifest entries stay, so that a replaced batch that is written again stays replaced.
        """
        live = {run for entries in self.live(spark).values() for run, _ in entries.values()}
        gone = [f for f in list_folders(spark, f"{self.path}/runs/run=*") if f.rsplit("run=", 1)[1] not in live]
        for folder in gone:
            delete(spark, folder)
        return len(gone)
