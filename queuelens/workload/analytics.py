"""KPI, distribution, chart and audit reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import access
from ..operators.predicates import all_of, date_range, include, present, urgent
from ..plans import distribution, heatmap, kpi, reports
from ..rules import DEFAULT_RULES
from .views import (AS_OF_ORDERS, REQUEST_LINES, REQUESTS, REQUESTS_PLACE, duck, request_lines,
                    requests, requests_place)

AS_OF = AS_OF_ORDERS
D = f"DATE '{AS_OF}'"
DIAG = "entidade_cidPrincipal_descricao"
ACTOR = "medicoSolicitante"
COLOUR = "entidade_classificacaoRisco_cor"


# --- headline figures -------------------------------------------------------------

def kpi_summary(spark, sf):
    """All stored and derived figures under a two-clause filter."""
    rows = request_lines(spark, sf)
    where = all_of([present(F.col(ACTOR)), include(F.col("origem_lista"), ["O", "F"])])
    return kpi.kpi_summary(rows, where, AS_OF)


# one row per request first, then the figures over requests
_KPI_BASE = f"""
dated AS (SELECT *, CAST(dataSolicitacao AS DATE) AS asked, CAST(dataCadastro AS DATE) AS touched FROM v
  WHERE coalesce(medicoSolicitante, '') <> '' AND origem_lista IN ('O', 'F')),
r AS (SELECT numeroCMCE AS id, COUNT(*) AS n, COUNT(asked) AS n_asked, SUM(date_diff('day', asked, {D})) AS waited,
  MIN(asked) AS first_day, MAX(asked) AS last_day, MAX(touched) AS touched,
  bool_or(entidade_classificacaoRisco_cor IN ('VERMELHO','LARANJA','AMARELO')) AS pressing,
  bool_or(date_diff('day', asked, {D}) > 180) AS late FROM dated GROUP BY id),
k AS (SELECT COUNT(id) AS pacientes, CAST(SUM(n) AS BIGINT) AS eventos,
  ROUND(SUM(waited) / SUM(n_asked), 1) AS lead_time, date_diff('day', MIN(first_day), {D}) AS max_lead_time,
  date_diff('day', MIN(first_day), MAX(last_day)) AS span_dias, COUNT(id) FILTER (pressing) AS pac_urgentes,
  COUNT(id) FILTER (late) AS pac_vencidos, quantile_cont(date_diff('day', first_day, {D}), 0.9) AS p90_lead_time,
  quantile_cont(date_diff('day', touched, {D}), 0.9) AS p90_esquecido, CAST(0 AS DOUBLE) AS last_sync_at FROM r),
p AS (SELECT {', '.join(f"COUNT(DISTINCT {c}) AS {n}" for n, c in kpi.DIMENSIONS.items())} FROM dated)
"""


def _ratio(top: str, bottom: str, scale: str = "1.0") -> str:
    return (f"CASE WHEN {bottom} > 0 THEN CAST(printf('%.1f', CAST({top} AS DOUBLE) / {bottom} * {scale})"
            f" AS DOUBLE) ELSE 0.0 END")


KPI_SQL = f"WITH v AS ({REQUEST_LINES}), {_KPI_BASE}" + f"""
SELECT k.*, p.*, {_ratio('eventos', 'pacientes')} AS evo_por_paciente,
  {_ratio('sub_esp', 'esp_mae')} AS sub_por_esp, {_ratio('cids', 'medicos')} AS cid_por_medico,
  {_ratio('eventos', 'medicos')} AS evo_por_medico,
  CAST(printf('%.1f', pacientes / GREATEST(span_dias / CAST(30.416 AS DOUBLE), 1.0)) AS DOUBLE) AS cad_por_mes,
  {_ratio('pac_urgentes', 'pacientes', '100.0')} AS taxa_urgencia,
  {_ratio('pac_vencidos', 'pacientes', '100.0')} AS taxa_vencidos
FROM k, p"""


def kpi_empty(spark, sf):
    """A filter without rows gives zeros, not nulls."""
    return kpi.kpi_summary(request_lines(spark, sf), F.col("origem_lista") == "none", AS_OF)


KPI_EMPTY_SQL = """
SELECT CAST(COUNT(*) AS BIGINT) AS pacientes, CAST(COUNT(*) AS BIGINT) AS eventos,
  CAST(COUNT(*) AS BIGINT) AS esp_mae, CAST(COUNT(*) AS BIGINT) AS sub_esp,
  CAST(COUNT(*) AS BIGINT) AS medicos, CAST(COUNT(*) AS BIGINT) AS cids,
  CAST(COUNT(*) AS BIGINT) AS origens, CAST(COUNT(*) AS BIGINT) AS max_lead_time,
  CAST(COUNT(*) AS BIGINT) AS span_dias, CAST(COUNT(*) AS BIGINT) AS pac_urgentes,
  CAST(COUNT(*) AS BIGINT) AS pac_vencidos, CAST(COUNT(*) AS DOUBLE) AS lead_time,
  CAST(COUNT(*) AS DOUBLE) AS p90_lead_time, CAST(COUNT(*) AS DOUBLE) AS p90_esquecido,
  CAST(COUNT(*) AS DOUBLE) AS evo_por_paciente, CAST(COUNT(*) AS DOUBLE) AS sub_por_esp,
  CAST(COUNT(*) AS DOUBLE) AS cid_por_medico, CAST(COUNT(*) AS DOUBLE) AS evo_por_medico,
  CAST(COUNT(*) AS DOUBLE) AS cad_por_mes, CAST(COUNT(*) AS DOUBLE) AS taxa_urgencia,
  CAST(COUNT(*) AS DOUBLE) AS taxa_vencidos, CAST(COUNT(*) AS DOUBLE) AS last_sync_at
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'none'"""


def kpi_p90(spark, sf):
    """Exact interpolated P90 of waits per request."""
    w = distribution.waits(request_lines(spark, sf), None, AS_OF)
    return w.agg(F.percentile("dias_fila", 0.9).alias("p90_lead_time"),
                 F.percentile("dias_esquecido", 0.9).alias("p90_esquecido"))


_WAITS = f"""w AS (SELECT numeroCMCE, date_diff('day', MIN(CAST(dataSolicitacao AS DATE)), {D}) AS dias_fila,
  date_diff('day', MAX(CAST(dataCadastro AS DATE)), {D}) AS dias_esquecido FROM v GROUP BY numeroCMCE)"""
P90_SQL = f"""WITH v AS ({REQUEST_LINES}), {_WAITS}
SELECT PERCENTILE_CONT(0.90) WITHIN GROUP (ORDER BY dias_fila) AS p90_lead_time,
  PERCENTILE_CONT(0.90) WITHIN GROUP (ORDER BY dias_esquecido) AS p90_esquecido FROM w"""


def wait_distribution(spark, sf):
    """Waits per request, the input of the box plots."""
    return distribution.waits(request_lines(spark, sf), None, AS_OF).select(
        "numeroCMCE", F.col("dias_fila").cast("bigint").alias("dias_fila"),
        F.col("dias_esquecido").cast("bigint").alias("dias_esquecido"))


WAITS_SQL = f"WITH v AS ({REQUEST_LINES}), {_WAITS} SELECT * FROM w"


def wait_deciles(spark, sf):
    """Quartiles, deciles and the share inside the 3 x IQR fence."""
    return distribution.deciles(distribution.waits(request_lines(spark, sf), None, AS_OF))


_LONG = """m AS (SELECT 'dias_fila' AS measure, dias_fila AS days FROM w
  UNION ALL SELECT 'dias_esquecido', dias_esquecido FROM w),
q AS (SELECT measure, quantile_cont(days, 0.25) AS q1, quantile_cont(days, 0.75) AS q3
  FROM m GROUP BY measure)"""
DECILES_SQL = f"""WITH v AS ({REQUEST_LINES}), {_WAITS}, {_LONG}
SELECT m.measure, COUNT(*) AS n, MAX(q1) AS q1, MAX(q3) AS q3,
  quantile_cont(days, 0.1) AS p10, quantile_cont(days, 0.9) AS p90,
  CAST(COUNT(*) FILTER (WHERE days <= q3 + 3.0 * (q3 - q1)) AS BIGINT) AS n_inside
FROM m JOIN q ON m.measure = q.measure GROUP BY m.measure"""


def boxplot_stats(spark, sf):
    """Five box-plot figures per measure."""
    return distribution.boxplot(distribution.waits(request_lines(spark, sf), None, AS_OF)).select(
        "measure", F.col("low_fence").cast("bigint").alias("low_fence"), "q1", "median", "q3",
        F.col("high_fence").cast("bigint").alias("high_fence"))


BOXPLOT_SQL = f"""WITH v AS ({REQUEST_LINES}), {_WAITS}, {_LONG},
c AS (SELECT m.* FROM m JOIN q ON m.measure = q.measure WHERE days <= q3 + 3.0 * (q3 - q1)),
b AS (SELECT measure, quantile_cont(days, 0.25) AS q1, quantile_cont(days, 0.5) AS med,
  quantile_cont(days, 0.75) AS q3 FROM c GROUP BY measure)
SELECT c.measure, COALESCE(MIN(days) FILTER (WHERE days >= q1 - 1.5 * (q3 - q1)), MIN(days)) AS low_fence,
  MAX(q1) AS q1, MAX(med) AS median, MAX(q3) AS q3,
  COALESCE(MAX(days) FILTER (WHERE days <= q3 + 1.5 * (q3 - q1)), MAX(days)) AS high_fence
FROM c JOIN b ON c.measure = b.measure GROUP BY c.measure"""


def hash_sample(spark, sf):
    """Repeatable sample with a fixed upper size."""
    w = distribution.waits(request_lines(spark, sf), None, AS_OF)
    return distribution.seeded_sample(w, "numeroCMCE", 1000, 42).select(
        "numeroCMCE", F.col("dias_fila").cast("bigint").alias("dias_fila"))


SAMPLE_SQL = f"""WITH v AS ({REQUEST_LINES}), {_WAITS}
SELECT numeroCMCE, dias_fila FROM w ORDER BY md5(CONCAT(CAST(numeroCMCE AS VARCHAR), ':', '42')), numeroCMCE
LIMIT 1000"""


# --- options and bounds -----------------------------------------------------------

def dynamic_options(spark, sf):
    """Distinct non-empty values under a filter."""
    return access.options(request_lines(spark, sf), DIAG, urgent(F.col(COLOUR), DEFAULT_RULES.urgent_colours))


def global_bounds(spark, sf):
    """A10, F1, F2: lenient bounds of a text number, a number and a date."""
    return kpi.bounds(requests(spark, sf), {
        "numero": ("usuarioSUS_numero", "text"), "pontos": ("entidade_classificacaoRisco_totalPontos", "number"),
        "nascimento": ("usuarioSUS_dataNascimento", "date")})


def _bound(name: str, expr: str) -> str:
    return (f"SELECT '{name}' AS name, CAST(MIN({expr}) AS VARCHAR) AS vmin, "
            f"CAST(MAX({expr}) AS VARCHAR) AS vmax FROM v")


BOUNDS_SQL = duck(" UNION ALL ".join([
    _bound("numero", "TRY_CAST(usuarioSUS_numero AS INTEGER)"),
    _bound("pontos", "TRY_CAST(entidade_classificacaoRisco_totalPontos AS INTEGER)"),
    _bound("nascimento", "TRY_CAST(usuarioSUS_dataNascimento AS DATE)")]), v=REQUESTS)


# --- charts -----------------------------------------------------------------------

DIMS = ["usuarioSUS_municipioResidencia_nome", "usuarioSUS_bairro", "situacao"]


def volume_by_dims(spark, sf):
    """Volume and mean wait per chosen dimensions."""
    return reports.volume_by(requests_place(spark, sf), None, DIMS, "espera")


_LEAVES = f"""SELECT usuarioSUS_municipioResidencia_nome,
  COALESCE(NULLIF(usuarioSUS_bairro, ''), 'Não Informado') AS usuarioSUS_bairro, situacao, Vol, Metrica_Cor
FROM (SELECT {', '.join(DIMS)}, COUNT(DISTINCT numeroCMCE) AS Vol,
  ROUND(AVG(SLA_Lead_Time_Total_Dias), 1) AS Metrica_Cor FROM v GROUP BY {', '.join(DIMS)})"""
VOLUME_SQL = duck(_LEAVES, v=REQUESTS_PLACE)


def volume_by_age(spark, sf):
    """A11 with the age measure."""
    return reports.volume_by(requests_place(spark, sf), None, ["origem_lista"], "idade", AS_OF)


VOLUME_AGE_SQL = duck(f"""SELECT origem_lista, COUNT(DISTINCT numeroCMCE) AS Vol,
  ROUND(AVG(date_diff('year', TRY_CAST(usuarioSUS_dataNascimento AS DATE), {D})), 1) AS Metrica_Cor
  FROM v GROUP BY origem_lista""", v=REQUESTS_PLACE)


def hierarchy_rollup(spark, sf):
    """Totals per level of the nested chart."""
    leaves = reports.volume_by(requests_place(spark, sf), None, DIMS, "espera")
    return reports.hierarchy(leaves, DIMS).withColumn("Metrica_Cor", F.round("Metrica_Cor", 6))


HIERARCHY_SQL = duck(f"""SELECT a.*, CAST(1 AS INTEGER) AS depth FROM (
  SELECT usuarioSUS_municipioResidencia_nome, CAST(NULL AS VARCHAR) AS usuarioSUS_bairro,
  CAST(NULL AS VARCHAR) AS situacao, CAST(SUM(Vol) AS BIGINT) AS Vol,
  ROUND(SUM(Metrica_Cor * Vol) / SUM(Vol), 6) AS Metrica_Cor FROM leaf GROUP BY 1) a
UNION ALL SELECT b.*, 2 FROM (SELECT usuarioSUS_municipioResidencia_nome, usuarioSUS_bairro,
  CAST(NULL AS VARCHAR), CAST(SUM(Vol) AS BIGINT), ROUND(SUM(Metrica_Cor * Vol) / SUM(Vol), 6)
  FROM leaf GROUP BY 1, 2) b
UNION ALL SELECT c.*, 3 FROM (SELECT usuarioSUS_municipioResidencia_nome, usuarioSUS_bairro, situacao,
  CAST(SUM(Vol) AS BIGINT), ROUND(SUM(Metrica_Cor * Vol) / SUM(Vol), 6) FROM leaf GROUP BY 1, 2, 3) c""",
                     v=REQUESTS_PLACE, leaf=_LEAVES)


def risk_volume(spark, sf):
    """Volume per risk colour."""
    return reports.risk_volume(request_lines(spark, sf))


RISK_SQL = duck("""SELECT entidade_classificacaoRisco_cor, COUNT(DISTINCT numeroCMCE) AS Vol FROM v
  WHERE entidade_classificacaoRisco_cor <> '' GROUP BY 1""", v=REQUEST_LINES)


def status_volume(spark, sf):
    """Volume per status."""
    return reports.status_volume(requests(spark, sf))


STATUS_SQL = duck("SELECT situacao, COUNT(DISTINCT numeroCMCE) AS Vol FROM v GROUP BY 1 ORDER BY 2 DESC, 1",
                  v=REQUESTS)


def place_top30(spark, sf):
    """Largest places and sub-places."""
    return reports.place_top(requests_place(spark, sf))


PLACE_SQL = duck("""SELECT usuarioSUS_municipioResidencia_nome,
  COALESCE(NULLIF(usuarioSUS_bairro, ''), 'Não Informado') AS usuarioSUS_bairro, Vol
FROM (SELECT usuarioSUS_municipioResidencia_nome, usuarioSUS_bairro, COUNT(DISTINCT numeroCMCE) AS Vol
  FROM v WHERE usuarioSUS_municipioResidencia_nome <> '' GROUP BY 1, 2
  ORDER BY 3 DESC, 1, 2 NULLS LAST LIMIT 30)""", v=REQUESTS_PLACE)


def age_sex_volume(spark, sf):
    """Volume per age and sex."""
    return reports.age_sex_volume(requests(spark, sf), None, AS_OF)


AGE_SEX_SQL = duck(f"""SELECT CAST(Idade_Int AS INTEGER) AS Idade_Int, usuarioSUS_sexo,
  COUNT(DISTINCT numeroCMCE) AS Vol
FROM (SELECT date_diff('year', TRY_CAST(usuarioSUS_dataNascimento AS DATE), {D}) AS Idade_Int,
  usuarioSUS_sexo, numeroCMCE FROM v) WHERE Idade_Int IS NOT NULL AND Idade_Int >= 0 GROUP BY 1, 2""",
                   v=REQUESTS)


def daily_throughput(spark, sf):
    """Requests per day and list."""
    return reports.daily_throughput(requests_place(spark, sf))


DAILY_SQL = duck("""SELECT CAST(dataSolicitacao AS DATE) AS Dia, origem_lista, COUNT(DISTINCT numeroCMCE) AS Vol
  FROM v WHERE dataSolicitacao IS NOT NULL GROUP BY 1, 2""", v=REQUESTS_PLACE)


def top_actors(spark, sf):
    """Ten actors with most requests."""
    return reports.top_actors(request_lines(spark, sf), ACTOR)


TOP_ACTORS_SQL = duck("""SELECT medicoSolicitante, COUNT(DISTINCT numeroCMCE) AS Vol FROM v
  WHERE medicoSolicitante <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""", v=REQUEST_LINES)


def funnel_stages(spark, sf):
    """Four stage counts in one pass."""
    return reports.funnel(requests(spark, sf), F.col("SLA_Lead_Time_Total_Dias") > 50)


FUNNEL_SQL = duck(" UNION ALL ".join(
    f"SELECT '{label}' AS Etapa, COUNT(DISTINCT numeroCMCE) AS Vol FROM v "
    f"WHERE SLA_Lead_Time_Total_Dias > 50 {cond}" for label, cond in [
        ("1. Solicitado", ""), ("2. Triado", "AND entidade_classificacaoRisco_cor <> ''"),
        ("3. Agendado", "AND situacao ILIKE '%AGENDADA%'"),
        ("4. Realizado", "AND (situacao ILIKE '%ATENDIDO%' OR situacao ILIKE '%REALIZADO%')")]),
    v=REQUESTS)


# --- actor x diagnosis ------------------------------------------------------------

def actor_diag_having(spark, sf):
    """Frequent actor x diagnosis pairs."""
    return reports.actor_diagnosis(request_lines(spark, sf), ACTOR, DIAG)


HAVING_SQL = duck("""SELECT medicoSolicitante AS ator, entidade_cidPrincipal_descricao AS diag,
  COUNT(DISTINCT numeroCMCE) AS Vol FROM v WHERE medicoSolicitante <> '' AND medicoSolicitante IS NOT NULL
  AND entidade_cidPrincipal_descricao <> '' AND entidade_cidPrincipal_descricao IS NOT NULL
  GROUP BY 1, 2 HAVING COUNT(DISTINCT numeroCMCE) >= 3 ORDER BY 3 DESC, 1, 2 LIMIT 150""", v=REQUEST_LINES)


def actor_diag_topk(spark, sf):
    """Pairs of the top members of both axes."""
    return heatmap.cells(request_lines(spark, sf), ACTOR, DIAG, 15, 20)


_CELLS = """ta AS (SELECT medicoSolicitante FROM v WHERE medicoSolicitante <> '' AND medicoSolicitante IS NOT NULL
  GROUP BY 1 ORDER BY COUNT(DISTINCT numeroCMCE) DESC, 1 LIMIT 15),
td AS (SELECT entidade_cidPrincipal_descricao FROM v WHERE entidade_cidPrincipal_descricao <> ''
  AND entidade_cidPrincipal_descricao IS NOT NULL
  GROUP BY 1 ORDER BY COUNT(DISTINCT numeroCMCE) DESC, 1 LIMIT 20),
cells AS (SELECT medicoSolicitante AS ator, entidade_cidPrincipal_descricao AS diag,
  COUNT(DISTINCT numeroCMCE) AS Vol FROM v WHERE medicoSolicitante IN (SELECT * FROM ta)
  AND entidade_cidPrincipal_descricao IN (SELECT * FROM td) GROUP BY 1, 2)"""
CELLS_SQL = f"WITH v AS ({REQUEST_LINES}), {_CELLS} SELECT * FROM cells"

_MATRIX = """cut AS (SELECT CASE WHEN length(diag) > 45 THEN diag[:45] || '...' ELSE diag END AS diag, ator,
  AVG(Vol) AS Vol FROM cells GROUP BY 1, 2),
mat AS (SELECT d.diag, a.ator, COALESCE(cut.Vol, 0.0) AS Vol FROM (SELECT DISTINCT diag FROM cut) d
  CROSS JOIN (SELECT DISTINCT ator FROM cut) a LEFT JOIN cut ON cut.diag = d.diag AND cut.ator = a.ator)"""


def _heatmap(by):
    def query(spark, sf):
        grid = heatmap.matrix(heatmap.cells(request_lines(spark, sf), ACTOR, DIAG, 15, 20))
        return heatmap.z_scores(grid, by).select(
            "diag", "ator", F.round("Vol", 6).alias("Vol"), F.round("z", 6).alias("z"), "z_text")
    query.__doc__ = f"A29, A30, F18, F44: deviations within each {by}."
    return query


def _z_sql(by):
    return f"""WITH v AS ({REQUEST_LINES}), {_CELLS}, {_MATRIX},
s AS (SELECT diag, ator, Vol, (Vol - AVG(Vol) OVER (PARTITION BY {by})) /
  CASE WHEN STDDEV_SAMP(Vol) OVER (PARTITION BY {by}) = 0 THEN 1.0
       ELSE STDDEV_SAMP(Vol) OVER (PARTITION BY {by}) END AS z FROM mat)
SELECT diag, ator, ROUND(Vol, 6) AS Vol, ROUND(z, 6) AS z, printf('%+.1f', z) AS z_text FROM s"""


# --- row lists --------------------------------------------------------------------

def outlier_list(spark, sf):
    """Longest waits with quadrant flags."""
    return reports.outlier_list(requests(spark, sf), None, AS_OF, points_from_text=False)


OUTLIER_SQL = duck(f"""SELECT numeroCMCE,
  COALESCE(NULLIF(entidade_classificacaoRisco_cor, ''), 'Não Informado') AS entidade_classificacaoRisco_cor,
  Pontos, DiasFila, situacao, entidade_especialidade_descricao, Pontos >= 40 AS alta_gravidade,
  DiasFila >= 180 AS fora_sla
FROM (SELECT numeroCMCE, entidade_classificacaoRisco_cor,
  TRY_CAST(entidade_classificacaoRisco_totalPontos AS INTEGER) AS Pontos,
  CAST(date_diff('day', CAST(dataSolicitacao AS DATE), {D}) AS INTEGER) AS DiasFila, situacao,
  entidade_especialidade_descricao FROM v
  WHERE dataSolicitacao IS NOT NULL AND situacao NOT ILIKE '%ENCERRADA%'
  ORDER BY DiasFila DESC NULLS LAST, Pontos DESC NULLS LAST, numeroCMCE LIMIT 3000)""", v=REQUESTS)


def audit_list(spark, sf):
    """Newest requests."""
    return reports.audit_list(requests(spark, sf), None, 250)


AUDIT_SQL = duck("""SELECT numeroCMCE, CAST(dataSolicitacao AS DATE) AS "Solicitação",
  dataCadastro AS "Data_Evolução", situacao, entidade_classificacaoRisco_cor AS "Risco Cor",
  historico_quadro_clinico FROM v ORDER BY dataSolicitacao DESC, dataCadastro DESC, numeroCMCE LIMIT 250""",
                 v=REQUESTS)


def recent_default_range(spark, sf):
    """The default date range is the last 30 days."""
    r = requests(spark, sf)
    return r.filter(date_range(F.col("dataSolicitacao"), as_of=AS_OF)).select("numeroCMCE", "situacao")


RECENT_SQL = duck(f"""SELECT numeroCMCE, situacao FROM v
  WHERE CAST(dataSolicitacao AS DATE) BETWEEN {D} - 30 AND {D}""", v=REQUESTS)


QUERIES = {
    "kpi_summary": (kpi_summary, KPI_SQL),
    "kpi_empty": (kpi_empty, KPI_EMPTY_SQL),
    "kpi_p90": (kpi_p90, P90_SQL),
    "wait_distribution": (wait_distribution, WAITS_SQL),
    "wait_deciles": (wait_deciles, DECILES_SQL),
    "boxplot_stats": (boxplot_stats, BOXPLOT_SQL),
    "hash_sample": (hash_sample, SAMPLE_SQL),
    "dynamic_options": (dynamic_options, duck(
        """SELECT DISTINCT entidade_cidPrincipal_descricao FROM v
  WHERE entidade_classificacaoRisco_cor IN ('VERMELHO','LARANJA','AMARELO')
  AND entidade_cidPrincipal_descricao IS NOT NULL AND entidade_cidPrincipal_descricao <> ''""",
        v=REQUEST_LINES)),
    "global_bounds": (global_bounds, BOUNDS_SQL),
    "volume_by_dims": (volume_by_dims, VOLUME_SQL),
    "volume_by_age": (volume_by_age, VOLUME_AGE_SQL),
    "hierarchy_rollup": (hierarchy_rollup, HIERARCHY_SQL),
    "risk_volume": (risk_volume, RISK_SQL),
    "status_volume": (status_volume, STATUS_SQL),
    "place_top30": (place_top30, PLACE_SQL),
    "age_sex_volume": (age_sex_volume, AGE_SEX_SQL),
    "daily_throughput": (daily_throughput, DAILY_SQL),
    "top_actors": (top_actors, TOP_ACTORS_SQL),
    "funnel_stages": (funnel_stages, FUNNEL_SQL),
    "actor_diag_having": (actor_diag_having, HAVING_SQL),
    "actor_diag_topk": (actor_diag_topk, CELLS_SQL),
    "heatmap_z_row": (_heatmap("diag"), _z_sql("diag")),
    "heatmap_z_col": (_heatmap("ator"), _z_sql("ator")),
    "outlier_list": (outlier_list, OUTLIER_SQL),
    "audit_list": (audit_list, AUDIT_SQL),
    "recent_default_range": (recent_default_range, RECENT_SQL),
}
