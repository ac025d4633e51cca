"""Dealing rows out over tasks before an aggregation with about as many groups as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..sources.files import size_of

#: Bytes of stored input whose rows one task aggregates.
TASK_BYTES = 4 << 20
#: Tasks that the requests of one group are dealt out to.
SHARES = 16


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` by the hash of ``keys``, over a number of tasks that grows with the files that they come from.

    Adaptive coalescing goes by shuffled bytes and joins partitions until there are about as many as cores, so the groups
    that one task holds would grow with the input. A number that is asked for is kept. Aggregations by ``keys``, or by
    more columns than those, need no further exchange.
    """
    spark = rows.sparkSession
    least = spark.sparkContext.defaultParallelism
    files = rows.inputFiles()
    wanted = -(-size_of(spark, files) // TASK_BYTES) if files else int(spark.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(least, wanted), *keys)


def distinct_per_group(rows: DataFrame, key: str, *groups: str) -> DataFrame:
    """``Vol``: distinct non-null ``key`` per combination of ``groups``, for many groups as well as for huge ones.

    A group's rows are dealt out to ``SHARES`` tasks by the key, counted there and summed up.
    """
    shared = rows.select(key, *groups).withColumn("__share", F.pmod(F.xxhash64(key), F.lit(SHARES)))
    counted = spread(shared, *groups, "__share").groupBy(*groups, "__share").agg(F.countDistinct(key).alias("Vol"))
    return spread(counted, *groups).groupBy(*groups).agg(F.sum("Vol").alias("Vol"))
