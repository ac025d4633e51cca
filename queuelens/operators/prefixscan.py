"""Ordered scans over keys of any size: rows by rank, in pieces of bounded size.

A window over a key puts all of its rows into one task. Here rows are dealt out by ranges of (key, order), so that a
task holds a share of the rows whatever the keys and however the order values lie. A row's place within its task
is its row number, each (task, key) leaves one summary, and an exclusive prefix over the summaries gives every row its
rank. Pieces of the rank then carry windows or nested groups of bounded size, and a caller that folds each piece to a
mergeable summary combines those in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import scratch_dir

PART_BITS = 33  # of ``monotonically_increasing_id``: row number below, partition above


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` through a table in the shared work folder; what hangs on row numbers needs rows that stay where they are."""
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def matching(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Equality of the keys, nulls included."""
    condition = F.lit(True)
    for key in keys:
        condition = condition & left[key].eqNullSafe(right[key])
    return condition


def ranked(df: DataFrame, by: list[str], order: list[str], rank: str = "rank", size: str = "group_rows",
           partitions: int | None = None) -> DataFrame:
    """``df`` with each row's rank (from 0, by ``order``, nulls first) within its ``by`` key and the key's row count.

    Rows that agree on ``by`` and ``order`` are told apart by a number given when they are read, which also lets ranges
    cut through them. The input is stored once in order.
    """
    spark = df.sparkSession
    count = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    marked = df.withColumn("__tie", F.monotonically_increasing_id())
    keys = [*by, *order, "__tie"]
    placed = stored(marked.repartitionByRange(count, *keys).sortWithinPartitions(*keys)
                    .withColumn("__at", F.monotonically_increasing_id()).drop("__tie"), "ranked")
    part, pos = F.shiftright("__at", PART_BITS), F.col("__at").bitwiseAND((1 << PART_BITS) - 1)
    cut = placed.withColumns({"__part": part, "__pos": pos})
    sums = stored(cut.groupBy(*by, "__part").agg(F.count(F.lit(1)).alias("__n"), F.min("__pos").alias("__first")), "rank-sums")
    earlier = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*by, "__part", (F.coalesce(F.sum("__n").over(earlier), F.lit(0)) - F.col("__first")).alias("__offset"),
                          F.sum("__n").over(Window.partitionBy(*by)).alias(size))
    # one row per task and per key within it; a task's rows are the most that share a key of this join
    found = cut.join(offsets, matching(cut, offsets, [*by, "__part"]))
    return found.select(*[cut[c] for c in df.columns], (F.col("__pos") + F.col("__offset")).alias(rank), offsets[size])


def in_pieces(df: DataFrame, by: list[str], order: list[str], block: int = 1_000_000, most_heavy: int = 100_000,
              piece: str = "__piece") -> DataFrame:
    """``df`` with a piece number: pieces of a key follow each other in ``order`` and hold at most ``block`` rows.

    Keys of up to ``block`` rows are one piece and move in the caller's shuffle only. The rows of larger ones are ranked
    first. There are at most ``most_heavy`` of those, as ``block`` grows until that holds, so their keys can be broadcast.
    """
    large_keys = df.groupBy(*by).agg(F.count(F.lit(1)).alias("count")).where(F.col("count") > block)
    if large_keys.isEmpty():
        return df.withColumn(piece, F.lit(0).cast("bigint"))
    counts = stored(large_keys, "heavy-keys")
    number = counts.count()
    while number > most_heavy:
        block *= 2
        counts = counts.where(F.col("count") > block)
        number = counts.count()
    heavy = F.broadcast(counts.select(*[F.col(k).alias(f"__h_{k}") for k in by]))
    same = F.lit(True)
    for key in by:
        same = same & F.col(key).eqNullSafe(F.col(f"__h_{key}"))
    large = ranked(df.join(heavy, same, "left_semi"), by, order, "__rank", "__rows")
    cut = large.withColumn(piece, F.floor(F.col("__rank") / F.lit(block))).drop("__rank", "__rows")
    return df.join(heavy, same, "left_anti").withColumn(piece, F.lit(0).cast("bigint")).unionByName(cut)
