"""Chart and audit reports. Each takes the request frame, a predicate and parameters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import (age_years, blank_label, day_diff, lenient_int, sql_round)
from ..operators.predicates import (contains_ignoring_case, present)
from ..operators.spread import distinct_per_group
from ..rules import DEFAULT_RULES, Rules, as_date

KEY = "numeroCMCE"
COLOUR = "entidade_classificacaoRisco_cor"


def _rows(df: DataFrame, predicate: Column | None) -> DataFrame:
    return df if predicate is None else df.filter(predicate)


def _volume() -> Column:
    return F.countDistinct(KEY).alias("Vol")


def measure(name: str, as_of=None) -> Column:
    """Row value whose rounded mean a chart can show."""
    # Chart measures and their columns.
    columns = {
        "espera": "SLA_Lead_Time_Total_Dias",
        "esquecido": "SLA_Tempo_Regulador_Dias",
        "gravidade": "entidade_classificacaoRisco_pontosGravidade",
        "tempo": "entidade_classificacaoRisco_pontosTempo",
        "total": "entidade_classificacaoRisco_totalPontos",
    }
    if name == "idade":
        return age_years(F.col("usuarioSUS_dataNascimento"), as_date(as_of))
    return F.col(columns[name])


def volume_by(df: DataFrame, predicate: Column | None, dims: Sequence[str],
              metric: str | None = None, as_of=None) -> DataFrame:
    """Distinct requests per combination of up to five dimensions, with a mean measure.

    Null and '' dimension values are labelled after grouping, as two separate groups.
    """
    figures = [_volume()]
    if metric:
        figures.append(sql_round(F.avg(measure(metric, as_of)), 1).alias("Metrica_Cor"))
    return (_rows(df, predicate).groupBy(*dims).agg(*figures)
            .withColumns({d: blank_label(F.col(d)) for d in dims}))


def hierarchy(leaves: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Totals for every level of a nested chart from the leaf volumes.

    A parent's volume is the sum of its leaves, its measure their volume-weighted mean.
    """
    weight = F.sum("Vol")
    depth = F.lit(len(dims)) - F.bit_count(F.grouping_id())
    return leaves.rollup(*dims).agg(
        weight.alias("Vol"),
        (F.sum(F.col("Metrica_Cor") * F.col("Vol")) / weight).alias("Metrica_Cor"),
        depth.cast("int").alias("depth")).filter("depth > 0")


def risk_volume(df: DataFrame, predicate: Column | None = None) -> DataFrame:
    return _rows(df, predicate).filter(F.col(COLOUR) != "").groupBy(COLOUR).agg(_volume())


def funnel(df: DataFrame, predicate: Column | None = None) -> DataFrame:
    """Four journey stages from one pass: stage flags per request, then four counts.

    The flags are combined per request first, so the shuffle carries each request once
    and not once per stage.
    """
    state = F.col("situacao")
    flags = _rows(df, predicate).filter(F.col(KEY).isNotNull()).groupBy(KEY).agg(
        F.lit(True).alias("s1"),
        F.bool_or(F.col(COLOUR) != "").alias("s2"),
        F.bool_or(contains_ignoring_case(state, "AGENDADA")).alias("s3"),
        F.bool_or(contains_ignoring_case(state, "ATENDIDO")
                  | contains_ignoring_case(state, "REALIZADO")).alias("s4"))
    counts = flags.agg(*[F.count_if(F.col(s)).alias(s) for s in ["s1", "s2", "s3", "s4"]])
    # Stage labels.
    return counts.select(F.inline(F.array(*[
        F.struct(F.lit(label).alias("Etapa"), F.col(s).alias("Vol"))
        for label, s in [("1. Solicitado", "s1"), ("2. Triado", "s2"),
                         ("3. Agendado", "s3"), ("4. Realizado", "s4")]])))


def status_volume(df: DataFrame, predicate: Column | None = None) -> DataFrame:
    return (_rows(df, predicate).groupBy("situacao").agg(_volume())
            .orderBy(F.desc("Vol"), F.col("situacao").asc_nulls_last()))


def place_top(df: DataFrame, predicate: Column | None = None, n: int = 30) -> DataFrame:
    """Volume per place and sub-place, largest first; ties in name order."""
    place, sub = "usuarioSUS_municipioResidencia_nome", "usuarioSUS_bairro"
    return (_rows(df, predicate).filter(F.col(place) != "").groupBy(place, sub).agg(_volume())
            .orderBy(F.desc("Vol"), place, F.col(sub).asc_nulls_last()).limit(n)
            .withColumn(sub, blank_label(F.col(sub))))


def age_sex_volume(df: DataFrame, predicate: Column | None, as_of) -> DataFrame:
    age = age_years(F.col("usuarioSUS_dataNascimento"), as_date(as_of))
    return (_rows(df, predicate).select(age.alias("Idade_Int"), "usuarioSUS_sexo", KEY)
            .filter("Idade_Int >= 0").groupBy("Idade_Int", "usuarioSUS_sexo").agg(_volume()))


def daily_throughput(df: DataFrame, predicate: Column | None = None) -> DataFrame:
    return (_rows(df, predicate).filter("dataSolicitacao IS NOT NULL")
            .groupBy(F.col("dataSolicitacao").cast("date").alias("Dia"), "origem_lista")
            .agg(_volume()))


def actor_diagnosis(df: DataFrame, actor: str, diagnosis: str, predicate: Column | None = None,
                    at_least: int = 3, n: int = 150) -> DataFrame:
    """Most frequent actor x diagnosis pairs with at least ``at_least`` requests."""
    rows = _rows(df, predicate).filter(present(F.col(actor)) & present(F.col(diagnosis)))
    named = rows.select(KEY, F.col(actor).alias("ator"), F.col(diagnosis).alias("diag"))
    return (distinct_per_group(named, KEY, "ator", "diag")
            .filter(F.col("Vol") >= at_least)
            .orderBy(F.desc("Vol"), "ator", "diag").limit(n))


def top_actors(df: DataFrame, actor: str = "medicoSolicitante", predicate: Column | None = None,
               n: int = 10) -> DataFrame:
    return (distinct_per_group(_rows(df, predicate).filter(F.col(actor) != ""), KEY, actor)
            .orderBy(F.desc("Vol"), actor).limit(n))


def outlier_list(df: DataFrame, predicate: Column | None, as_of, n: int = 3000,
                 rules: Rules = DEFAULT_RULES, points_from_text: bool = True) -> DataFrame:
    """Longest waits first, then most points, with the two quadrant lines as flags."""
    open_rows = _rows(df, predicate).filter(
        F.col("dataSolicitacao").isNotNull() & ~contains_ignoring_case(F.col("situacao"), "ENCERRADA"))
    points = lenient_int(F.col("entidade_classificacaoRisco_totalPontos"), points_from_text)
    top = (open_rows.select(
        KEY, COLOUR, points.alias("Pontos"),
        day_diff(as_date(as_of), F.col("dataSolicitacao")).alias("DiasFila"),
        "situacao", "entidade_especialidade_descricao")
        .orderBy(F.desc_nulls_last("DiasFila"), F.desc_nulls_last("Pontos"), KEY).limit(n))
    return top.withColumns({
        COLOUR: blank_label(F.col(COLOUR)),
        "alta_gravidade": F.col("Pontos") >= rules.severity_line,
        "fora_sla": F.col("DiasFila") >= rules.sla_days})


def audit_list(df: DataFrame, predicate: Column | None = None, n: int = 100) -> DataFrame:
    """Newest requests with their clinical text; ``n`` lies within 10 .. 1000."""
    if not 10 <= n <= 1000:
        raise ValueError(f"n must lie within 10 .. 1000, not {n}")
    return (_rows(df, predicate)
            .orderBy(F.desc_nulls_last("dataSolicitacao"), F.desc_nulls_last("dataCadastro"), KEY)
            .limit(n)
            .select(KEY, F.col("dataSolicitacao").cast("date").alias("Solicitação"),
                    F.col("dataCadastro").alias("Data_Evolução"), "situacao",
                    F.col(COLOUR).alias("Risco Cor"), "historico_quadro_clinico"))
