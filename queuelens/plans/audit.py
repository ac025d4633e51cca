"""Integrity and freshness checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import sql_round
from ..operators.contract import legacy_columns
from ..operators.predicates import present
from ..rules import DEFAULT_RULES, Rules


def sla_means(df: DataFrame) -> DataFrame:
    """Mean lead time, most interactions, closed requests; rows without a lead time left out."""
    return df.filter("SLA_Lead_Time_Total_Dias IS NOT NULL").agg(
        sql_round(F.avg(F.col("SLA_Lead_Time_Total_Dias").cast("double")), 1).alias("media_lead_time_dias"),
        F.max(F.col("SLA_Interacoes_Regulacao").cast("int")).alias("maximo_ping_pong"),
        F.count_if("SLA_Desfecho_Atingido").alias("qtd_casos_encerrados"))


def snapshot_sample(df: DataFrame, n: int = 3) -> DataFrame:
    """A few rows with a specialty; the smallest keys, so the sample is repeatable."""
    return (df.filter(present(F.col("entidade_especialidade_descricao"))).orderBy("numeroCMCE").limit(n)
            .select("numeroCMCE", F.col("entidade_especialidade_descricao").alias("especialidade"),
                    F.col("entidade_classificacaoRisco_cor").alias("risco")))


def integrity_audit(df: DataFrame) -> DataFrame:
    """Volume, retired columns and SLA means in one row."""
    found = ", ".join(legacy_columns(df))
    volume = df.agg(F.count(F.lit(1)).alias("total"))
    both = volume.unionByName(sla_means(df), allowMissingColumns=True)
    one = both.agg(*[F.max(c).alias(c) for c in both.columns])
    return one.withColumns({"not_empty": F.col("total") > 0, "legacy_columns": F.lit(found)})


def freshness(df: DataFrame, now, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """Age in hours of the newest file behind a scan; 0 files or a stamp of 0 mean unknown.

    ``df`` must be a file scan; only file metadata is read, no data column.
    """
    newest = df.select(F.col("_metadata.file_modification_time").alias("t")).agg(F.max("t").alias("t"))
    stamp = F.coalesce(F.unix_millis("t") / 1000.0, F.lit(0.0))
    hours = (F.unix_millis(F.lit(str(now)).cast("timestamp")) / 1000.0 - stamp) / 3600.0
    return newest.select(stamp.alias("last_sync_at"), F.when(stamp > 0, hours).alias("age_hours"),
                         F.coalesce((stamp > 0) & (hours > rules.freshness_hours), F.lit(False)).alias("stale"))
