"""Headline figures of the waiting list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import day_diff, lenient_int, python_round, ratio, sql_round
from ..operators.predicates import urgent, waiting_longer
from ..operators.spread import spread
from ..rules import DEFAULT_RULES, Rules, as_date
from ..session import scratch_dir
from ..sources.files import write_parquet

# Dimensions whose distinct values are counted, by result name.
DIMENSIONS = {
    "esp_mae": "entidade_especialidade_especialidadeMae_descricao",
    "sub_esp": "entidade_especialidade_descricao",
    "medicos": "medicoSolicitante",
    "cids": "entidade_cidPrincipal_descricao",
    "origens": "origem_lista",
}


def per_request(df: DataFrame, as_of, rules: Rules = DEFAULT_RULES, by: list[str] | None = None) -> DataFrame:
    """One row per request (and per combination of the columns ``by``): rows, waits and flags.

    Everything that needs the request key comes out of this one aggregation. Partial
    aggregation reduces a request with very many rows to one row per map task.
    """
    requested = F.col("dataSolicitacao").cast("date")
    wait = day_diff(as_date(as_of), requested)
    return df.groupBy("numeroCMCE", *(by or [])).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(requested).alias("n_dated"),
        F.sum(wait.cast("bigint")).alias("sum_wait"),
        F.min(requested).alias("first_day"),
        F.max(requested).alias("last_day"),
        F.max(F.col("dataCadastro").cast("date")).alias("last_event"),
        F.bool_or(urgent(F.col("entidade_classificacaoRisco_cor"),
                         rules.urgent_colours)).alias("is_urgent"),
        F.bool_or(waiting_longer(requested, as_of, rules.sla_days)).alias("is_overdue"),
    )


def _exact_p90(days: Column) -> Column:
    # the state of ``percentile`` is one counter per distinct value; waits are whole days,
    # so it is bounded by the calendar span and not by the number of requests
    return F.percentile(days, 0.9)


def kpi_base(df: DataFrame, predicate: Column | None, as_of, rules: Rules = DEFAULT_RULES,
             last_sync_at: float = 0.0) -> DataFrame:
    """The 15 stored figures as one row, null figures as 0.

    The source is read once: it is reduced to one row per request and combination of the
    dimensions, with the wait figures, and stored in the work folder. Requests and dimensions
    are then counted apart from that; the request key stays out of Spark's expansion of many
    distinct counts. ``last_sync_at`` (epoch seconds) is the caller's, see ``last_sync``.
    """
    rows = df if predicate is None else df.filter(predicate)
    as_of_day = as_date(as_of)
    has_key = F.col("numeroCMCE").isNotNull()
    path = scratch_dir(df.sparkSession, "kpi")
    dims = list(DIMENSIONS.values())
    needed = rows.select("numeroCMCE", *dims, "dataSolicitacao", "dataCadastro", "entidade_classificacaoRisco_cor")
    write_parquet(per_request(spread(needed, "numeroCMCE", *dims), as_of, rules, dims), path)
    parts = df.sparkSession.read.parquet(path)
    by_request = parts.groupBy("numeroCMCE").agg(
        *[F.sum(c).alias(c) for c in ("n_rows", "n_dated", "sum_wait")], F.min("first_day").alias("first_day"),
        *[F.max(c).alias(c) for c in ("last_day", "last_event")],
        *[F.bool_or(c).alias(c) for c in ("is_urgent", "is_overdue")])
    keyed = by_request.agg(
        F.count_if(has_key).alias("pacientes"),
        F.sum("n_rows").alias("eventos"),
        (F.sum("sum_wait") / F.sum("n_dated")).alias("mean_wait"),
        F.max(day_diff(as_of_day, F.col("first_day"))).alias("max_lead_time"),
        day_diff(F.max("last_day"), F.min("first_day")).alias("span_dias"),
        F.count_if(has_key & F.col("is_urgent")).alias("pac_urgentes"),
        F.count_if(has_key & F.col("is_overdue")).alias("pac_vencidos"),
        _exact_p90(day_diff(as_of_day, F.col("first_day"))).alias("p90_lead_time"),
        _exact_p90(day_diff(as_of_day, F.col("last_event"))).alias("p90_esquecido"),
    )
    distinct = parts.agg(*[F.countDistinct(column).alias(name) for name, column in DIMENSIONS.items()])
    # both sides are one row; a union and a max put them side by side without a join
    both = keyed.unionByName(distinct, allowMissingColumns=True)
    one = both.agg(*[F.max(c).alias(c) for c in both.columns])
    whole = ["pacientes", "eventos", *DIMENSIONS, "max_lead_time", "span_dias",
             "pac_urgentes", "pac_vencidos"]
    return one.select(
        *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in whole],
        F.coalesce(sql_round(F.col("mean_wait"), 1), F.lit(0.0)).alias("lead_time"),
        F.coalesce(F.col("p90_lead_time"), F.lit(0.0)).alias("p90_lead_time"),
        F.coalesce(F.col("p90_esquecido"), F.lit(0.0)).alias("p90_esquecido"),
        F.lit(float(last_sync_at)).alias("last_sync_at"),
    )


def last_sync(df: DataFrame) -> float:
    """Time of the newest file of a stored frame in epoch seconds, 0.0 without files."""
    newest = df.select(F.unix_micros("_metadata.file_modification_time").alias("t")).agg(F.max("t")).first()[0]
    return (newest or 0) / 1e6


def kpi_ratios(kpis: DataFrame, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """Add the derived ratios; a ratio over nothing is 0.0."""
    c = F.col
    months = F.greatest(c("span_dias") / F.lit(rules.commercial_month), F.lit(1.0))
    per_month = F.when(c("pacientes") > 0, python_round(c("pacientes") / months, 1)).otherwise(0.0)
    return kpis.withColumns({
        "evo_por_paciente": ratio(c("eventos"), c("pacientes")),
        "sub_por_esp": ratio(c("sub_esp"), c("esp_mae")),
        "cid_por_medico": ratio(c("cids"), c("medicos")),
        "evo_por_medico": ratio(c("eventos"), c("medicos")),
        "cad_por_mes": per_month,
        "taxa_urgencia": ratio(c("pac_urgentes"), c("pacientes"), scale=100.0),
        "taxa_vencidos": ratio(c("pac_vencidos"), c("pacientes"), scale=100.0),
    })


def kpi_summary(df: DataFrame, predicate: Column | None, as_of, rules: Rules = DEFAULT_RULES,
                last_sync_at: float = 0.0) -> DataFrame:
    return kpi_ratios(kpi_base(df, predicate, as_of, rules, last_sync_at), rules)


def bounds(df: DataFrame, columns: dict[str, tuple[str, str]]) -> DataFrame:
    """Smallest and largest value (as text) of several columns after a lenient cast, in one pass.

    ``columns``: result name -> (column, ``text``, ``number`` or ``date``).
    """
    values = {name: F.col(c).try_cast("date") if kind == "date" else lenient_int(F.col(c), kind == "text")
              for name, (c, kind) in columns.items()}
    one = df.agg(*[f(v).cast("string").alias(f"{name}/{end}") for name, v in values.items()
                   for end, f in (("min", F.min), ("max", F.max))])
    return one.select(F.inline(F.array(*[F.struct(
        F.lit(name).alias("name"), F.col(f"`{name}/min`").alias("vmin"), F.col(f"`{name}/max`").alias("vmax"))
        for name in columns])))
