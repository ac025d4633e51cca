"""Register events: de-duplication, validation and dead letters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import valid_crm_number, valid_crm_state

# Event form and kind taken in.
EVENT_DDL = "id STRING, type STRING, userId STRING, details STRUCT<crm_numero: STRING, crm_uf: STRING>"
REGISTER = "REGISTER"
FAILED = "Falha de processamento final após retries."


def kafka_events(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """(value, timestamp) of a topic; offsets are kept by the query's checkpoint."""
    return (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
            .option("subscribe", topic).option("startingOffsets", "earliest").load()
            .select(F.col("value").cast("string").alias("value"), "timestamp"))


def kafka_dead_letters(dead: DataFrame, servers: str, topic: str) -> None:
    """Send dead letters of a batch as JSON messages."""
    (dead.select(F.to_json(F.struct("original_payload", "error")).alias("value"))
     .write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save())


def distinct_events(raw: DataFrame, watermark: str = "1 day") -> DataFrame:
    """Parsed events, each id once. Repeats later than the watermark would pass again."""
    parsed = raw.withWatermark("timestamp", watermark).select(
        "timestamp", "value", F.from_json("value", EVENT_DDL).alias("e"))
    return parsed.select("timestamp", F.col("value").alias("original_payload"), "e.*") \
        .dropDuplicatesWithinWatermark(["id"])


def registrations(events: DataFrame) -> DataFrame:
    return events.filter(F.col("type") == REGISTER).select(
        "timestamp", "id", "userId", F.col("details.crm_numero").alias("crm_numero"),
        F.col("details.crm_uf").alias("crm_uf"), "original_payload")


def is_valid(blocked: tuple[str, ...] = ()) -> Column:
    """Events without registration data pass; given data must be well formed.

    ``blocked`` lists numbers the registry refuses.
    """
    number, state = F.col("crm_numero"), F.col("crm_uf")
    given = (F.coalesce(number, F.lit("")) != "") & (F.coalesce(state, F.lit("")) != "")
    return ~given | (valid_crm_number(number) & valid_crm_state(state) & ~number.isin(list(blocked)))


def split(events: DataFrame, blocked: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(valid registrations, dead letters)."""
    ok = is_valid(blocked)
    dead = events.filter(~ok).select("original_payload", F.lit(FAILED).alias("error"))
    return events.filter(ok).drop("original_payload"), dead
