"""The waiting-list tables expressed over the driver's star-schema tables.

Each view is one SELECT in SQL that both engines understand. Spark binds the table names
to DataFrames; the oracle runs the same text over its own views of the parquet files.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..session import use_utc

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

AS_OF_ORDERS = "2001-08-02"
AS_OF_EVENTS = "2024-03-01"

COLOUR_CASE = """CASE o_orderpriority WHEN '1-URGENT' THEN 'VERMELHO' WHEN '2-HIGH' THEN 'LARANJA'
    WHEN '3-MEDIUM' THEN 'AMARELO' WHEN '5-LOW' THEN 'VERDE' ELSE '' END"""
STATUS_CASE = """CASE o_orderstatus WHEN 'O' THEN 'AGENDADA' WHEN 'F' THEN 'REALIZADO'
    ELSE 'AGUARDA_REGULACAO' END"""

# one row per request, orders alone
REQUESTS = f"""
SELECT o_orderkey AS numeroCMCE,
  o_orderdate AS dataSolicitacao,
  CAST(o_orderdate AS DATE) + CAST(o_orderkey % 90 AS INTEGER) AS dataCadastro,
  {STATUS_CASE} AS situacao,
  {COLOUR_CASE} AS entidade_classificacaoRisco_cor,
  o_totalprice AS entidade_classificacaoRisco_totalPontos,
  o_totalprice / 1000 AS SLA_Lead_Time_Total_Dias,
  CONCAT('MED', CAST(o_custkey AS VARCHAR(20))) AS medicoSolicitante,
  CONCAT('ESP', CAST(o_custkey % 40 AS VARCHAR(20))) AS entidade_especialidade_descricao,
  CASE WHEN o_custkey % 23 = 0 THEN 'desconhecida'
    ELSE CAST(DATE '1930-01-01' + CAST(o_custkey * 37 % 32000 AS INTEGER) AS VARCHAR(20)) END
    AS usuarioSUS_dataNascimento,
  CASE WHEN o_custkey % 2 = 0 THEN 'Feminino' ELSE 'Masculino' END AS usuarioSUS_sexo,
  CASE WHEN o_orderkey % 11 = 0 THEN 'S/N'
    ELSE CONCAT(CAST(o_custkey % 1000 AS VARCHAR(20)), '.5') END AS usuarioSUS_numero,
  CASE WHEN o_orderstatus = 'F' THEN TRUE WHEN o_orderstatus = 'O' THEN FALSE END
    AS SLA_Desfecho_Atingido,
  CASE WHEN o_orderstatus = 'O' THEN ''
    WHEN o_orderstatus = 'F' THEN CASE o_orderkey % 3 WHEN 0 THEN 'POSITIVO'
      WHEN 1 THEN 'NEGATIVO' ELSE 'ABANDONO' END END AS SLA_Tipo_Desfecho,
  CASE o_orderkey % 5 WHEN 0 THEN 'SIM' WHEN 1 THEN '' END AS liminarOrdemJudicial,
  CASE WHEN o_orderstatus = 'P' THEN CONCAT('{{''tipo'': ''', o_orderpriority,
      ''', ''descricao'': ''Falta exame (', CAST(o_custkey % 7 AS VARCHAR(20)),
      ')'', ''status'': ''', CASE WHEN o_orderkey % 2 = 0 THEN 'Aberta' ELSE 'Fechada' END,
      '''}}') ELSE '' END AS motivoPendencia,
  CONCAT('Pedido ', CAST(o_orderkey AS VARCHAR(20)), ' com prioridade ', o_orderpriority)
    AS historico_quadro_clinico
FROM orders
"""

# requests with list and place of residence
REQUESTS_PLACE = f"""
SELECT o_orderkey AS numeroCMCE,
  o_orderdate AS dataSolicitacao,
  CAST(o_orderdate AS DATE) + CAST(o_orderkey % 90 AS INTEGER) AS dataCadastro,
  {STATUS_CASE} AS situacao,
  {COLOUR_CASE} AS entidade_classificacaoRisco_cor,
  o_totalprice / 1000 AS SLA_Lead_Time_Total_Dias,
  CAST(DATE '1930-01-01' + CAST(o_custkey * 37 % 32000 AS INTEGER) AS VARCHAR(20))
    AS usuarioSUS_dataNascimento,
  c_mktsegment AS origem_lista,
  n_name AS usuarioSUS_municipioResidencia_nome,
  CASE WHEN c_custkey % 17 = 0 THEN '' WHEN c_custkey % 19 = 0 THEN NULL
    ELSE CONCAT('BAIRRO', CAST(c_custkey % 4 AS VARCHAR(20))) END AS usuarioSUS_bairro
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
"""

# several rows per request: one per order line, with actor and diagnosis
REQUEST_LINES = f"""
SELECT l_orderkey AS numeroCMCE,
  o_orderdate AS dataSolicitacao,
  l_shipdate AS dataCadastro,
  {COLOUR_CASE} AS entidade_classificacaoRisco_cor,
  p_type AS entidade_especialidade_especialidadeMae_descricao,
  CONCAT(p_type, ' ', p_brand) AS entidade_especialidade_descricao,
  CONCAT('MED', CAST(l_suppkey AS VARCHAR(20))) AS medicoSolicitante,
  CONCAT(p_name, ' com especificacao clinica detalhada de ', p_brand, ' e ', p_type)
    AS entidade_cidPrincipal_descricao,
  o_orderstatus AS origem_lista
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
"""

# request history: one row per event
HISTORY = """
SELECT user_id AS request, ts, event_id AS seq, event_type, value,
  CASE event_type WHEN 'signup' THEN 'AGUARDA_REGULACAO' WHEN 'error' THEN 'AGUARDA_REAVALIACAO'
    WHEN 'click' THEN 'AUTORIZADA' WHEN 'view' THEN 'AGENDADA'
    ELSE CASE WHEN k % 20 <> 0 THEN 'EM_ANALISE' WHEN k % 3 = 0 THEN 'REALIZADA'
      WHEN k % 3 = 1 THEN 'CANCELADA' ELSE 'ENCERRADA' END END AS state,
  CONCAT('Ator', CAST(event_id % 9 AS VARCHAR(20))) AS actor
FROM (SELECT *, CAST({k} AS BIGINT) AS k FROM events) e
"""
HISTORY_SPARK = HISTORY.format(k="get_json_object(props, '$.k')")
HISTORY_DUCK = HISTORY.format(k="json_extract_string(props, '$.k')")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    use_utc(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run a view's SELECT with every driver table it names bound to a parquet scan."""
    names = [t for t in TABLES if re.search(rf"(FROM|JOIN) {t}\b", sql)]
    text = sql.replace("{", "{{").replace("}", "}}")
    for name in names:
        text = re.sub(rf"(FROM|JOIN) {name}\b", rf"\1 {{{name}}}", text)
    return spark.sql(text, **{n: table(spark, sf_dir, n) for n in names})


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, REQUESTS)


def requests_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, REQUESTS_PLACE)


def request_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, REQUEST_LINES)


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with state; the timestamp is a zoned one (UTC), as streams need it."""
    df = view(spark, sf_dir, HISTORY_SPARK)
    return df.withColumn("ts", df.ts.cast("timestamp"))


def duck(body: str, **views: str) -> str:
    """Oracle SQL: named views as common table expressions in front of ``body``."""
    ctes = ", ".join(f"{name} AS ({sql})" for name, sql in views.items())
    return f"WITH {ctes} {body}" if ctes else body
