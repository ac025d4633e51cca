"""Column profiles over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profile as p
from ..session import scratch_dir
from ..sources.files import write_parquet
from .views import REQUESTS, duck, requests, table

C = F.col
PART = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]


def _pairs_sql(columns, source="part"):
    return " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value FROM {source}"
                              for c in columns)


_FREQ = f"""pairs AS ({_pairs_sql(PART)}),
f AS (SELECT "column", value, COUNT(*) AS "Quantidade" FROM pairs GROUP BY 1, 2)"""


def value_frequency(spark, sf):
    """Frequency of every value of every column."""
    return p.value_frequency(table(spark, sf, "part"))


def frequent_texts(spark, sf):
    """The ten most frequent values of long and short text columns, counted by hashes; ties by value."""
    docs = table(spark, sf, "documents").select("text", "lang", "source", F.substring("text", 1, 40).alias("opening"))
    return p.frequent_values(docs, 10).select("column", F.md5("value").alias("value_md5"), "Quantidade")


_DOC_PAIRS = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {e} AS value FROM documents" for c, e in (
    ("text", "text"), ("lang", "lang"), ("source", "source"), ("opening", "substr(text, 1, 40)")))
FREQUENT_SQL = f"""SELECT "column", md5(value) AS value_md5, n AS "Quantidade" FROM (
  SELECT "column", value, COUNT(*) AS n FROM ({_DOC_PAIRS}) WHERE value IS NOT NULL GROUP BY 1, 2)
QUALIFY ROW_NUMBER() OVER (PARTITION BY "column" ORDER BY n DESC, value) <= 10"""


def profile_columns(spark, sf):
    """Counts, cardinality, top values, sensitive names."""
    part = table(spark, sf, "part")
    joined = p.counts(part).join(p.top_values(p.frequent_values(part)), "column")
    return joined.withColumn("sensivel", C("column").isin([c for c in part.columns if p.is_sensitive(c)]))


COLUMNS_SQL = f"""WITH {_FREQ}, c AS (SELECT "column", CAST(SUM("Quantidade") AS BIGINT) AS total_linhas,
  CAST(SUM(CASE WHEN value IS NULL THEN "Quantidade" ELSE 0 END) AS BIGINT) AS nulos, COUNT(value) AS n_unicos,
  CAST(SUM(CASE WHEN lower(trim(value)) IN ('','nan','none','null','na','n/a','não informado','nao informado')
    THEN "Quantidade" ELSE 0 END) AS BIGINT) AS vazios_textuais FROM f GROUP BY 1),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY "column" ORDER BY "Quantidade" DESC, value) AS rn
  FROM f WHERE value IS NOT NULL),
t AS (SELECT "column", CAST(to_json(list({{'valor': value, 'freq': "Quantidade"}} ORDER BY rn)) AS VARCHAR) AS top_5_valores,
  arg_min(value, rn) AS valor_mais_frequente, MAX("Quantidade") AS freq_valor_mais_frequente
  FROM r WHERE rn <= 5 GROUP BY 1)
SELECT c.*, ROUND(CAST(nulos AS DOUBLE) / total_linhas * 100, 4) AS pct_nulos,
  ROUND(CAST(n_unicos AS DOUBLE) / total_linhas * 100, 4) AS pct_unicos,
  ROUND(CAST(vazios_textuais AS DOUBLE) / total_linhas * 100, 4) AS pct_vazios_textuais,
  CASE WHEN n_unicos = 0 THEN 'sem valores' WHEN n_unicos = 1 THEN 'constante'
    WHEN n_unicos / total_linhas >= 0.95 THEN 'quase unica' WHEN n_unicos / total_linhas >= 0.5 THEN 'alta'
    WHEN n_unicos / total_linhas >= 0.05 THEN 'media' ELSE 'baixa' END AS cardinalidade,
  top_5_valores, valor_mais_frequente, freq_valor_mais_frequente, FALSE AS sensivel
FROM c JOIN t ON c."column" = t."column\""""


def profile_numeric(spark, sf):
    """Numeric statistics of all numeric columns."""
    stats = p.numeric_stats(table(spark, sf, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_linenumber"))
    floats = [c for c, t in stats.dtypes if t == "double"]
    return stats.select("column", *[F.round(c, 4).alias(c) if c in floats else c for c in stats.columns if c != "column"])


_NUM = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST({c} AS DOUBLE) AS v FROM lineitem"
                          for c in ["l_quantity", "l_extendedprice", "l_discount", "l_linenumber"])
NUMERIC_SQL = f"""WITH n AS ({_NUM}), q AS (SELECT "column", quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS q2,
  quantile_cont(v, 0.75) AS q3 FROM n GROUP BY 1)
SELECT n."column", ROUND(MIN(v), 4) AS num_min, ROUND(MAX(q1), 4) AS num_p25, ROUND(MAX(q2), 4) AS num_mediana,
  ROUND(AVG(v), 4) AS num_media, ROUND(MAX(q3), 4) AS num_p75, ROUND(MAX(v), 4) AS num_max,
  ROUND(STDDEV_SAMP(v), 4) AS num_std, COUNT(*) FILTER (v = 0) AS num_zeros, COUNT(*) FILTER (v < 0) AS num_negativos,
  ROUND(MAX(q3 - q1), 4) AS num_iqr,
  COUNT(*) FILTER (v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS num_outliers_iqr,
  ROUND(100.0 * COUNT(*) FILTER (v = 0) / COUNT(*), 4) AS num_pct_zeros,
  ROUND(100.0 * COUNT(*) FILTER (v < 0) / COUNT(*), 4) AS num_pct_negativos,
  ROUND(100.0 * COUNT(*) FILTER (v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) / COUNT(*), 4) AS num_pct_outliers_iqr
FROM n JOIN q ON n."column" = q."column" GROUP BY 1"""


def profile_datetime(spark, sf):
    """Date statistics."""
    stats = p.datetime_stats(table(spark, sf, "lineitem").select("l_shipdate"), "2000-06-01")
    return stats.withColumns({"data_min": F.date_format("data_min", "yyyy-MM-dd HH:mm:ss"),
                              "data_max": F.date_format("data_max", "yyyy-MM-dd HH:mm:ss"),
                              "data_pct_futuras": F.round("data_pct_futuras", 4),
                              "data_pct_antes_2000": F.round("data_pct_antes_2000", 4)})


DATETIME_SQL = """SELECT 'l_shipdate' AS "column", strftime(MIN(l_shipdate), '%Y-%m-%d %H:%M:%S') AS data_min,
  strftime(MAX(l_shipdate), '%Y-%m-%d %H:%M:%S') AS data_max,
  COUNT(*) FILTER (l_shipdate > TIMESTAMP '2000-06-01') AS data_futuras,
  COUNT(*) FILTER (l_shipdate < TIMESTAMP '2000-01-01') AS data_antes_2000,
  CAST(date_sub('day', MIN(l_shipdate), MAX(l_shipdate)) AS BIGINT) AS data_amplitude_dias,
  ROUND(100.0 * COUNT(*) FILTER (l_shipdate > TIMESTAMP '2000-06-01') / COUNT(*), 4) AS data_pct_futuras,
  ROUND(100.0 * COUNT(*) FILTER (l_shipdate < TIMESTAMP '2000-01-01') / COUNT(*), 4) AS data_pct_antes_2000
FROM lineitem"""


def profile_boolean(spark, sf):
    """Flag statistics."""
    stats = p.boolean_stats(requests(spark, sf).select("SLA_Desfecho_Atingido"))
    return stats.withColumns({c: F.round(c, 4) for c in ["bool_pct_true", "bool_pct_false"]})


BOOLEAN_SQL = duck("""SELECT 'SLA_Desfecho_Atingido' AS "column", COUNT(*) FILTER ("SLA_Desfecho_Atingido") AS bool_true,
  COUNT(*) FILTER (NOT "SLA_Desfecho_Atingido") AS bool_false,
  ROUND(100.0 * COUNT(*) FILTER ("SLA_Desfecho_Atingido") / COUNT(*), 4) AS bool_pct_true,
  ROUND(100.0 * COUNT(*) FILTER (NOT "SLA_Desfecho_Atingido") / COUNT(*), 4) AS bool_pct_false FROM v""", v=REQUESTS)


def profile_text(spark, sf):
    """Text length statistics of whole texts."""
    stats = p.text_stats(table(spark, sf, "documents").select("text", "lang", "source"))
    return stats.withColumn("txt_len_media", F.round("txt_len_media", 4))


_TXT = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", length({c}) AS n FROM documents" for c in ["text", "lang", "source"])
TEXT_SQL = f"""SELECT "column", CAST(MIN(n) AS INTEGER) AS txt_len_min, ROUND(AVG(n), 4) AS txt_len_media,
  quantile_cont(n, 0.5) AS txt_len_mediana, CAST(MAX(n) AS INTEGER) AS txt_len_max FROM ({_TXT}) GROUP BY 1"""


def _profile(spark, sf):
    part = table(spark, sf, "part").withColumn("p_seen", F.lit("2020-01-05"))
    path = scratch_dir(spark, "frequencies")
    write_parquet(p.value_frequency(part), path)
    return p.profile(part, ["p_partkey"], "2001-08-02", spark.read.parquet(path))


def profile_sorted(spark, sf):
    """The whole profile, main fields."""
    return _profile(spark, sf).select("coluna", "tipo_inferido", "cardinalidade", "n_unicos", "amostra_valores",
                                      "observacoes", F.round("num_mediana", 4).alias("num_mediana"))


def profile_types(spark, sf):
    """Summary per analytical type."""
    s = p.type_summary(_profile(spark, sf))
    return s.select("tipo_inferido", "qtd_colunas", F.round("media_pct_nulos", 4).alias("media_pct_nulos"),
                    F.round("media_pct_unicos", 4).alias("media_pct_unicos"))


_SAMPLE = "(SELECT CAST(to_json(list(CAST({c} AS VARCHAR) ORDER BY p_partkey)) AS VARCHAR) FROM (SELECT * FROM part ORDER BY p_partkey LIMIT 3))"
_ROWS = [("p_partkey", "'numerica_discreta'", 1), ("p_name", "'categorica'", 0), ("p_brand", "'categorica'", 0),
         ("p_type", "'categorica'", 0), ("p_size", "'numerica_discreta'", 1),
         ("p_retailprice", "'numerica_continua'", 1)]


def _share(c: str) -> str:
    return f"(SELECT COUNT(DISTINCT {c}) / COUNT(*) FROM part)"


def _profile_row(c: str, kind: str, numeric: int) -> str:
    dominance = f"(SELECT MAX(n) / SUM(n) FROM (SELECT COUNT(*) AS n FROM part GROUP BY {c}))"
    notes = (f"concat_ws('; ', CASE WHEN {_share(c)} >= 0.95 THEN 'alta unicidade' END" + ("" if numeric else
             f", CASE WHEN {dominance} >= 0.95 THEN 'categoria dominante >95%' WHEN {dominance} >= 0.8 "
             "THEN 'categoria dominante >80%' END") + ")")
    return f"""SELECT '{c}' AS coluna, {kind} AS tipo_inferido, CASE WHEN {_share(c)} >= 0.95 THEN 'quase unica'
      WHEN {_share(c)} >= 0.5 THEN 'alta' WHEN {_share(c)} >= 0.05 THEN 'media' ELSE 'baixa' END AS cardinalidade,
      (SELECT COUNT(DISTINCT {c}) FROM part) AS n_unicos, {_SAMPLE.format(c=c)} AS amostra_valores, {notes} AS observacoes,
      {f'(SELECT ROUND(quantile_cont(CAST({c} AS DOUBLE), 0.5), 4) FROM part)' if numeric else 'CAST(NULL AS DOUBLE)'} AS num_mediana"""


PROFILE_SQL = " UNION ALL ".join(_profile_row(*r) for r in _ROWS) + """ UNION ALL SELECT 'p_seen', 'booleana_textual',
  'constante', 1, '["2020-01-05","2020-01-05","2020-01-05"]', 'coluna constante; categoria dominante >95%', NULL"""
TYPES_SQL = f"""SELECT tipo_inferido, COUNT(*) AS qtd_colunas, 0.0::DOUBLE AS media_pct_nulos,
  ROUND(AVG(pct), 4) AS media_pct_unicos FROM (""" + " UNION ALL ".join(
    f"SELECT {k} AS tipo_inferido, ROUND({_share(c)} * 100, 4) AS pct" for c, k, _ in _ROWS) + """
  UNION ALL SELECT 'booleana_textual', (SELECT ROUND(100.0 / COUNT(*), 4) FROM part)) GROUP BY 1"""


def profile_kinds(spark, sf):
    """Free text, date-like text, half dates, identifiers, sensitive names, empty-like values."""
    k = C("doc_id")
    day = F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), (k % 1000).cast("int")), "dd/MM/yyyy")
    docs = table(spark, sf, "documents").select(
        "doc_id", C("text").alias("relato"), day.alias("quando"),
        F.when(k % 2 == 0, day).otherwise(F.concat(F.lit("x"), "lang")).alias("misto"),
        F.concat("source", F.lit("-"), k.cast("string")).alias("cpf"), C("lang").alias("nome"),
        F.when(k % 4 == 0, "N/A").when(k % 4 == 1, "").when(k % 4 == 2, " nan ").otherwise(C("lang")).alias("vago"))
    rows = p.profile(docs, ["doc_id"], "2024-01-01")
    return rows.select("coluna", "tipo_inferido", "sensivel", "vazios_textuais",
                       C("observacoes").contains("parte convertivel").alias("half_dates"))


KINDS_SQL = """SELECT coluna, tipo_inferido, sensivel, CASE coluna WHEN 'vago' THEN COUNT(*) FILTER (doc_id % 4 < 3)
  WHEN 'doc_id' THEN NULL ELSE COUNT(*) FILTER (doc_id < 0) END AS vazios_textuais, coluna = 'misto' AS half_dates
FROM documents, (VALUES ('doc_id', 'identificador_potencial', FALSE), ('relato', 'texto_livre', FALSE),
  ('quando', 'data_hora_texto', FALSE), ('misto', 'categorica', FALSE), ('cpf', 'identificador_potencial', TRUE),
  ('nome', 'categorica', TRUE), ('vago', 'categorica', FALSE)) v(coluna, tipo_inferido, sensivel)
GROUP BY coluna, tipo_inferido, sensivel"""


def describe(spark, sf):
    """Summary figures of numeric columns, quartiles exact."""
    df = table(spark, sf, "part").select("p_size", "p_retailprice")
    stats = p.numeric_stats(df)
    n = p.numeric_pairs(df).groupBy("column").agg(F.count("value").alias("count"))
    return n.join(stats, "column").select(
        "column", "count", F.round("num_media", 4).alias("mean"), F.round("num_std", 4).alias("std"),
        C("num_min").alias("min"), F.round("num_p25", 4).alias("p25"), F.round("num_mediana", 4).alias("p50"),
        F.round("num_p75", 4).alias("p75"), C("num_max").alias("max"))


DESCRIBE_SQL = " UNION ALL ".join(f"""SELECT '{c}' AS "column", COUNT({c}) AS count, ROUND(AVG({c}), 4) AS mean,
  ROUND(STDDEV_SAMP({c}), 4) AS std, CAST(MIN({c}) AS DOUBLE) AS min, ROUND(quantile_cont(CAST({c} AS DOUBLE), 0.25), 4) AS p25,
  ROUND(quantile_cont(CAST({c} AS DOUBLE), 0.5), 4) AS p50, ROUND(quantile_cont(CAST({c} AS DOUBLE), 0.75), 4) AS p75,
  CAST(MAX({c}) AS DOUBLE) AS max FROM part""" for c in ["p_size", "p_retailprice"])


def group_counts(spark, sf):
    """Rows per group, largest first."""
    return table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).orderBy(
        F.desc("n"), "event_type")


def filtered_count(spark, sf):
    """Filtered counts and global measures in one pass."""
    return table(spark, sf, "events").agg(
        F.count_if(C("event_type") == "error").alias("errors"), F.count_if(C("value") > 10).alias("large"),
        F.round(F.avg("value"), 6).alias("mean_value"), F.max("value").alias("max_value"))


QUERIES = {
    "value_frequency": (value_frequency, f"WITH {_FREQ} SELECT * FROM f"),
    "frequent_texts": (frequent_texts, FREQUENT_SQL),
    "profile_columns": (profile_columns, COLUMNS_SQL),
    "profile_numeric": (profile_numeric, NUMERIC_SQL),
    "profile_datetime": (profile_datetime, DATETIME_SQL),
    "profile_boolean": (profile_boolean, BOOLEAN_SQL),
    "profile_text": (profile_text, TEXT_SQL),
    "profile_sorted": (profile_sorted, PROFILE_SQL),
    "profile_types": (profile_types, TYPES_SQL),
    "profile_kinds": (profile_kinds, KINDS_SQL),
    "describe": (describe, DESCRIBE_SQL),
    "group_counts": (group_counts, "SELECT event_type, COUNT(*) AS n FROM events GROUP BY 1 ORDER BY 2 DESC, 1"),
    "filtered_count": (filtered_count, """SELECT COUNT(*) FILTER (event_type = 'error') AS errors,
        COUNT(*) FILTER (value > 10) AS large, ROUND(AVG(value), 6) AS mean_value, MAX(value) AS max_value FROM events"""),
}
