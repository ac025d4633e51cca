"""Table layouts that later reads profit from: bucketed by the request, or clustered by date and list.

A bucketed table keeps the rows of a request in one bucket, sorted by it, and Spark knows that from the catalog: what groups
or joins by the request reads it without a shuffle. A clustered table is sorted by ranges of date and list, within files
and across them, in row groups of a bounded size, so that the statistics of the files tell a filter what to skip.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..operators.prefixscan import stored
from ..session import scratch_dir

REQUEST_KEY = "numeroCMCE"
CLUSTER_COLUMNS = ("dataSolicitacao", "origem_lista")


# --- bucketed by the request ----------------------------------------------------------------

def write_bucketed(df: DataFrame, name: str, path: str | None = None, key: str = REQUEST_KEY, buckets: int = 64) -> DataFrame:
    """Write ``df`` as table ``name`` in ``buckets`` sorted files; returns the table.

    One shuffle puts every bucket into one task, so the table has one file per bucket. Choose ``buckets`` such that a bucket fits a
    task (some hundred MB) at the size that the table will reach.
    """
    spark = df.sparkSession
    path = path or scratch_dir(spark, name)
    (df.repartition(buckets, F.col(f"`{key}`")).write.mode("overwrite").option("path", path)
     .bucketBy(buckets, key).sortBy(key).saveAsTable(name))
    # beside the data, hidden from readers, for sessions with another catalog
    note = json.dumps({"key": key, "buckets": buckets, "schema": spark.table(name).schema.json()})
    spark.createDataFrame([(note,)], "value STRING").coalesce(1).write.mode("overwrite").text(f"{path}/_layout")
    return spark.table(name)


def open_bucketed(spark: SparkSession, name: str, path: str) -> DataFrame:
    """Bind ``name`` to a bucketed table that another session has written; no data is read."""
    note = json.loads(spark.read.text(f"{path}/_layout/*.txt").first()[0])
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in T.StructType.fromJson(json.loads(note["schema"])).fields)
    spark.sql(f"CREATE TABLE `{name}` ({columns}) USING parquet CLUSTERED BY (`{note['key']}`) SORTED BY (`{note['key']}`) "
              f"INTO {note['buckets']} BUCKETS LOCATION '{path}'")
    return spark.table(name)


# --- clustered by date and list ---------------------------------------------------------------

def write_clustered(df: DataFrame, path: str, by: Sequence[str] = CLUSTER_COLUMNS, files: int | None = None,
                    row_group_mb: float = 32, mode: str = "overwrite") -> None:
    """Write ``df`` in ranges of ``by``, each file sorted and in row groups of about ``row_group_mb``.

    The input is stored once first: finding the ranges reads it twice. Days with very many rows are cut by the further columns
    and at last by a row number, so no file gets more than its share. ``files`` defaults to the shuffle partitions.
    """
    spark = df.sparkSession
    rows = stored(df, "to-cluster").withColumn("__tie", F.monotonically_increasing_id())
    keys = [*[F.col(f"`{c}`") for c in by], F.col("__tie")]
    count = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    (rows.repartitionByRange(count, *keys).sortWithinPartitions(*keys).drop("__tie").write.mode(mode)
     .option("compression", "snappy").option("parquet.block.size", int(row_group_mb * (1 << 20))).parquet(path))


def can_cluster(df: DataFrame, by: Sequence[str] = CLUSTER_COLUMNS) -> bool:
    return set(by) <= set(df.columns)
