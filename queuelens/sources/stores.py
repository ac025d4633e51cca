"""Raw document store and run log as append-only Parquet datasets.

Plain Parquet has no row updates. Each batch is one partition directory of its own, and
"last write wins" is applied when reading; the work of a write is that of its batch and not
of the store. Writing the same batch again replaces its directory, so a retried or replayed
batch leaves no duplicates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..operators.dedup import latest_per_key
from ..schema import RUN_LOG_SCHEMA
from .files import exists

# Run states.
SUCCESS, PARTIAL, FAILURE, CIRCUIT_BREAKER = "SUCCESS", "PARTIAL", "FAILURE", "CIRCUIT_BREAKER"
NO_KEY = "SEM_PROTOCOLO_"


RAW_SCHEMA = T.StructType([T.StructField("protocolo", T.StringType()), T.StructField("data_captura", T.TimestampType()),
                           T.StructField("data_alteracao", T.LongType()), T.StructField("conteudo_json", T.StringType()),
                           T.StructField("origem_lista", T.StringType())])
DEAD_SCHEMA = "raw STRING, errors ARRAY<STRING>, origem_lista STRING, batch_id BIGINT"


def head_of(text: str) -> str:
    """SQL of (key, stamp, storable) of a JSON document: key and change stamp, and whether it may be stored, that is, neither
    broken nor a reported fetch error. One parse and one pass over its fields."""
    fields = "STRUCT<numeroCMCE: STRING, dataAlterouUltimaSituacao: BIGINT, error: VARIANT>"
    # a filter on the parsed value would be pushed below the parse and repeat it for each of its terms
    parsed = f"transform(array(try_parse_json({text})), v -> struct(v, try_variant_get(v, '$', '{fields}') AS d))"
    return (f"element_at(transform({parsed}, p -> struct(p.d.numeroCMCE AS key, "
            "coalesce(p.d.dataAlterouUltimaSituacao, 0L) AS stamp, "
            "p.v IS NOT NULL AND NOT is_variant_null(p.v) AND p.d.error IS NULL AS storable)), 1)")


def stored_key(key: Column, text: Column) -> Column:
    """Key that a document is stored by: its own, or one made from its content."""
    return F.coalesce(key, F.concat(F.lit(NO_KEY), F.sha2(text, 256)))


def raw_rows(documents: DataFrame, text: str = "conteudo_json", list_name: str = "origem_lista",
             keep: tuple[str, ...] = ()) -> DataFrame:
    """Store rows of captured documents; corrupt ones are left out, ``keep`` passes columns.

    A document without a key gets one made from its content, so capturing it again meets
    the same key.
    """
    j = F.col(text)
    found = documents.select(j, F.col(list_name), *keep, F.inline(F.expr(
        f"transform(filter(array({head_of(text)}), h -> h.storable), h -> struct(h.key AS __k, h.stamp AS __stamp))")))
    return found.select(stored_key(F.col("__k"), j).alias("protocolo"),
                        F.current_timestamp().alias("data_captura"), F.col("__stamp").alias("data_alteracao"),
                        j.alias("conteudo_json"), F.col(list_name).alias("origem_lista"), *keep)


def append_batch(df: DataFrame, path: str, batch_id: int, by: tuple[str, ...] = ()) -> None:
    """Write a batch under its own partition, replacing an earlier try of the same batch;
    ``by`` names further partition columns above it."""
    (df.withColumn("batch_id", F.lit(batch_id).cast("bigint")).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").option("compression", "snappy")
     .partitionBy(*by, "batch_id").parquet(path))


def read_store(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Rows of a store. With a schema, a store without any row yet is an empty frame."""
    if schema is not None and not exists(spark, path):
        return spark.createDataFrame([], schema)
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def latest(spark: SparkSession, path: str, key: str, order: list[Column] | None = None,
           schema: T.StructType | str | None = None) -> DataFrame:
    """Current rows of an append-only store: per key the first in ``order``, by default the
    newest batch's."""
    return latest_per_key(read_store(spark, path, schema), key, order or [F.desc("batch_id")])


def compact(spark: SparkSession, path: str, target: str, key: str, batch_id: int) -> None:
    """Write the current rows as one batch (numbered as the last one taken in) of a fresh store."""
    append_batch(latest(spark, path, key).drop("batch_id"), target, batch_id)


# --- run log ------------------------------------------------------------------------------

def run_status(failed: int, breaker: bool = False, error: str = "") -> str:
    if breaker:
        return CIRCUIT_BREAKER
    return FAILURE if error else PARTIAL if failed else SUCCESS


RUNS_SCHEMA = T.StructType([*RUN_LOG_SCHEMA.fields, T.StructField("run_id", T.StringType())])


def log_run(spark: SparkSession, path: str, run_id: str, timestamp: float, duration_seconds: float,
            status: str, items_ingested: int = 0, items_failed: int = 0, bytes_processed: int = 0,
            target_lists: list[str] | None = None, error_message: str = "") -> None:
    """The audit row of a run; writing it again replaces it."""
    row = (timestamp, round(duration_seconds, 2), status, items_ingested, items_failed,
           bytes_processed, target_lists or [], error_message, run_id)
    (spark.createDataFrame([row], RUNS_SCHEMA).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path))


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return read_store(spark, path, RUNS_SCHEMA)


def last_runs(runs: DataFrame, n: int = 10) -> DataFrame:
    """Newest runs first."""
    return runs.orderBy(F.desc_nulls_last("timestamp")).limit(n)
