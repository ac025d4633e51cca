"""Sources, sinks, consolidation, upserts and audits."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from ..functions import unify_breaks
from ..operators import contract, dedup
from ..operators.jsonshape import record_lines
from ..operators.profile import value_frequency
from ..plans import audit, consolidate as cons, flatten as fl
from ..rules import DEFAULT_RULES
from ..schema import DATE_COLUMNS
from ..session import scratch_dir
from ..sources import files, stores
from ..sources.runs import KeyedStore
from .records import AS_OF, DOC_DUCK, SALT, _SNAP, _damaged
from .views import REQUESTS, duck, requests, table

C = F.col


# --- scans and sinks ----------------------------------------------------------------

def scan_view(spark, sf):
    """A parquet scan under a name, queried by SQL."""
    files.read_requests(spark, f"{sf}/orders.parquet", view="requests_scan", check=False)
    out = spark.sql("SELECT o_orderstatus, COUNT(*) AS n FROM requests_scan WHERE o_totalprice > 100000 GROUP BY 1")
    spark.catalog.dropTempView("requests_scan")
    return out


def row_count(spark, sf):
    """Number of source rows."""
    return table(spark, sf, "lineitem").agg(F.count(F.lit(1)).alias("n"))


def schema_table(spark, sf):
    """Columns and types of a file, with the number of filled cells."""
    orders = table(spark, sf, "orders")
    filled = orders.agg(*[F.count(c).alias(c) for c in orders.columns]).unpivot(
        [], orders.columns, "column_name", "filled")
    return files.schema_table(orders).join(filled, "column_name")


SCHEMA_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, '{kind}' AS type, COUNT({c}) AS filled FROM orders" for c, kind in [
        ("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"), ("o_totalprice", "double"),
        ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string")])


def lineage_cols(spark, sf):
    """File and load time per row."""
    rows = files.with_lineage(table(spark, sf, "part"))
    return rows.groupBy(F.regexp_extract("source_file", "([^/]+)$", 1).alias("source_file")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(C("ingestion_at").isNotNull()).alias("stamped"))


def parquet_roundtrip(spark, sf):
    """Create, overwrite, swap in a derived version, read back."""
    path = scratch_dir(spark, "parquet")
    part = table(spark, sf, "part")
    files.ensure_dataset(spark, path, part.schema)
    files.write_parquet(part, path)
    files.swap_in(spark.read.parquet(path).withColumn("p_size", C("p_size") + 1), path)
    return spark.read.parquet(path)


def csv_roundtrip(spark, sf):
    """Semicolon CSV with byte order mark."""
    path = scratch_dir(spark, "csv")
    d = table(spark, sf, "documents").select("doc_id", "lang", "text")
    files.write_csv(d, path, sep=";", bom=True)
    return files.read_csv(spark, path, d.schema, sep=";").select(
        "doc_id", "lang", F.md5(unify_breaks(C("text"))).alias("text"))


def csv_quoted_roundtrip(spark, sf):
    """Every field quoted."""
    path = scratch_dir(spark, "csvq")
    c = table(spark, sf, "conversations")
    files.write_csv(c, path, quote_all=True)
    return files.read_csv(spark, path, c.schema).select(
        "conv_id", "turn", "role", F.md5(unify_breaks(C("text"))).alias("text"))


def column_files(spark, sf):
    """Value frequencies, one CSV folder per column, read back."""
    path = scratch_dir(spark, "columns")
    files.write_column_files(value_frequency(table(spark, sf, "customer").select(
        "c_nationkey", "c_mktsegment")), path)
    back = spark.read.schema("value STRING, Quantidade BIGINT, column STRING").options(header=True, sep=";").csv(path)
    return back.select("column", "value", "Quantidade")


COLUMN_SQL = """SELECT 'c_nationkey' AS "column", CAST(c_nationkey AS VARCHAR) AS value, COUNT(*) AS "Quantidade"
  FROM customer GROUP BY 2 UNION ALL SELECT 'c_mktsegment', c_mktsegment, COUNT(*) FROM customer GROUP BY 2"""


# --- consolidation ------------------------------------------------------------------

#: Rows per landing CSV file, and how many rows share a key.
CSV_ROWS, SAME_KEY = 4000, 3


def _csv_source(spark, sf):
    """CSV files in two layouts plus files that lack a date column, under one folder.

    Files are named by the range of their rows (part number), so that their order by full
    path is the order of the rows; rows of one key lie in different files and layouts.
    """
    base = scratch_dir(spark, "load")
    text = F.date_format("dataSolicitacao", "dd/MM/yyyy HH:mm:ss")
    r = requests(spark, sf)
    full = r.select(
        F.when(C("numeroCMCE") % 13 == 0, " ").otherwise(_same_key(C("numeroCMCE")).cast("string")).alias("numeroCMCE"),
        "situacao", text.alias("dataSolicitacao"),
        *[F.lit(None).cast("string").alias(c) for c in DATE_COLUMNS if c != "dataSolicitacao"],
        C("medicoSolicitante").alias("operador_cpf"), C("historico_quadro_clinico"), C("usuarioSUS_numero"),
        C("numeroCMCE").alias("source_row"))
    first = full.filter("source_row % 2 = 0").drop("usuarioSUS_numero")
    second = full.filter("source_row % 2 = 1")
    for name, part in [("a", first), ("b", second)]:
        ordered = part.repartitionByRange("source_row").sortWithinPartitions("source_row")
        files.write_csv(ordered, f"{base}/{name}", quote_all=True, max_rows=CSV_ROWS)
    files.write_csv(full.drop("dataCadastro"), f"{base}/c")
    return f"{base}/*/*.csv"


def _same_key(row):
    """Runs of rows share a key; their number grows with the table."""
    return F.floor(row / SAME_KEY)


def consolidate(spark, sf):
    """Load, de-duplicate, anonymise, export, read back."""
    target = scratch_dir(spark, "consolidated")
    counts = cons.run_consolidation(spark, _csv_source(spark, sf), target, SALT)
    rows = spark.read.parquet(target)
    return rows.groupBy("situacao").agg(
        F.count(F.lit(1)).alias("n"), F.sum(C("source_row").cast("bigint")).alias("rows_sum"),
        F.count("operador_cpf").alias("hashed"), F.min("operador_cpf").alias("min_hash"),
        F.max(C("dataSolicitacao").cast("date")).alias("last_day"),
        F.count_if(C("usuarioSUS_numero") == "").alias("no_number"),
    ).withColumn("removed", F.lit(counts["removed"]).cast("bigint"))


CONS_SQL = duck(f"""SELECT situacao, COUNT(*) AS n, CAST(SUM(numeroCMCE) AS BIGINT) AS rows_sum,
  COUNT(medicoSolicitante) AS hashed, MIN(sha256(medicoSolicitante || '{SALT}')) AS min_hash,
  MAX(CAST(dataSolicitacao AS DATE)) AS last_day, COUNT(*) FILTER (numeroCMCE % 2 = 0) AS no_number,
  (SELECT COUNT(*) FROM orders) - (SELECT COUNT(*) FROM w) AS removed FROM w GROUP BY situacao""",
                v=REQUESTS, w="""SELECT * FROM v WHERE numeroCMCE % 13 <> 0 QUALIFY ROW_NUMBER() OVER
  (PARTITION BY numeroCMCE // 3 ORDER BY numeroCMCE % 2 DESC, numeroCMCE DESC) = 1""")


def bad_file_skip(spark, sf):
    """Files without all date columns are listed, the rest is loaded."""
    rows, errors = files.load_csv(spark, _csv_source(spark, sf))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count("dataSolicitacao").alias("dated")).withColumn(
        "kind", F.lit("loaded")).unionByName(errors.agg(
            (F.countDistinct("reason")).alias("n"), F.count_if(C("reason").contains("dataCadastro")).alias("dated"))
        .select("n", F.least("dated", F.lit(1)).alias("dated"), F.lit("skipped reasons").alias("kind")))


def union_by_name(spark, sf):
    """Frames with differing columns."""
    o = table(spark, sf, "orders")
    a = o.filter("o_orderkey % 2 = 0").select("o_orderkey", "o_orderstatus", "o_totalprice")
    b = o.filter("o_orderkey % 2 = 1").select("o_custkey", "o_orderkey", "o_totalprice")
    return a.unionByName(b, allowMissingColumns=True)


def typed_cleanup(spark, sf):
    """Raw documents to the typed table, with failures counted."""
    rows, failed = cons.convert_raw(_damaged(spark, sf), AS_OF, SALT)
    cols = ["numeroCMCE", "situacao", "entidade_classificacaoRisco_totalPontos", "SLA_Tempo_Regulador_Dias",
            "SLA_Interacoes_Regulacao", "SLA_Marco_Agendada", "regularizacaoAcesso"]
    good = rows.select(*cols, C("dataSolicitacao").cast("date").alias("dataSolicitacao"),
                       C("usuarioSUS_dataNascimento").cast("date").alias("usuarioSUS_dataNascimento"),
                       F.lit("ok").alias("kind"))
    bad = failed.select(C("protocolo").alias("numeroCMCE"), F.lit("failed").alias("kind"))
    return good.unionByName(bad, allowMissingColumns=True)


TYPED_SQL = f"""WITH d AS ({DOC_DUCK}), {_SNAP}, m AS (SELECT *, CAST(cmce AS BIGINT) % 12 AS r FROM y)
SELECT cmce AS "numeroCMCE", CASE r WHEN 2 THEN '5' ELSE s2 END AS situacao,
  CAST(k % 90 AS DOUBLE) AS "entidade_classificacaoRisco_totalPontos",
  CAST(printf('%.2f', reg / 86400000.0::DOUBLE) AS DOUBLE) AS "SLA_Tempo_Regulador_Dias",
  1 + CAST(s1 = 'ENCAMINHADA_AO_NIR' AS BIGINT) + CAST(NOT fin AS BIGINT) AS "SLA_Interacoes_Regulacao",
  s2 = 'AGENDADA' AS "SLA_Marco_Agendada", FALSE AS "regularizacaoAcesso",
  CAST(make_timestamp(t0 * 1000) AS DATE) AS "dataSolicitacao",
  CASE WHEN born <> 0 AND r <> 7 THEN CAST(make_timestamp(born * 1000) AS DATE) END AS "usuarioSUS_dataNascimento",
  'ok' AS kind FROM m WHERE r NOT IN (1, 3, 4, 9)
UNION ALL SELECT cmce, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'failed' FROM m WHERE r IN (1, 3, 4, 9)"""


def canonical_projection(spark, sf):
    """Fixed column order, absent columns as ''."""
    r = requests(spark, sf).select("numeroCMCE", "situacao", F.concat(
        "historico_quadro_clinico", F.lit("\r\nfim\n.")).alias("historico_quadro_clinico"))
    return fl.canonical(r, ["situacao", "corRegulador", "numeroCMCE", "historico_quadro_clinico"])


def drop_and_rename(spark, sf):
    """All columns but one, display names."""
    return table(spark, sf, "customer").drop("c_acctbal").withColumnsRenamed(
        {"c_name": "Nome", "c_mktsegment": "Origem (Lista)"})


# --- incremental --------------------------------------------------------------------

_RAW_SQL = """SELECT CAST(user_id AS VARCHAR) AS protocolo, CASE WHEN event_id % 50 = 0 THEN NULL
  ELSE epoch_us(ts) // 1000 END AS data_alteracao, event_type AS origem_lista, event_id, value FROM events"""


def _raw(spark, sf):
    e = table(spark, sf, "events")
    stamp = F.when(C("event_id") % 50 == 0, None).otherwise(F.unix_millis(C("ts").cast("timestamp")))
    return e.select(C("user_id").cast("string").alias("protocolo"), stamp.alias("data_alteracao"),
                    C("event_type").alias("origem_lista"), "event_id", "value")


def watermark_by_list(spark, sf):
    """Highest change stamp per list."""
    return dedup.watermarks(_raw(spark, sf))


def incremental_cut(spark, sf):
    """Rows above the watermark that the first half of the event ids had reached."""
    raw = _raw(spark, sf)
    middle = raw.agg(F.floor((F.min("event_id") + F.max("event_id")) / 2)).scalar()
    marks = dedup.watermarks(raw.filter(C("event_id") < middle))
    return dedup.incremental_cut(raw, marks).select("protocolo", "event_id", "origem_lista")


CUT_SQL = duck("""SELECT protocolo, event_id, r.origem_lista FROM r LEFT JOIN (SELECT origem_lista,
  COALESCE(MAX(data_alteracao), 0) AS wm FROM r WHERE event_id < (SELECT (MIN(event_id) + MAX(event_id)) // 2 FROM r)
  GROUP BY 1) m ON m.origem_lista = r.origem_lista
  WHERE NOT (COALESCE(wm, 0) > 0 AND COALESCE(data_alteracao, 0) > 0 AND COALESCE(data_alteracao, 0) <= COALESCE(wm, 0))""",
               r=_RAW_SQL)


def upsert_latest(spark, sf):
    """Three batches into an append-only store, newest per key on reading."""
    path = scratch_dir(spark, "store")
    raw = _raw(spark, sf)
    for batch in range(3):
        stores.append_batch(dedup.latest_per_key(raw.filter(C("event_id") % 3 == batch), "protocolo",
                                                 [F.desc("event_id")]), path, batch)
    # replaying a batch must not change anything
    stores.append_batch(dedup.latest_per_key(raw.filter(C("event_id") % 3 == 1), "protocolo",
                                             [F.desc("event_id")]), path, 1)
    target = scratch_dir(spark, "compacted")
    stores.compact(spark, path, target, "protocolo", 2)
    return spark.read.parquet(target).select("protocolo", "event_id", "value")


UPSERT_SQL = duck("""SELECT protocolo, event_id, value FROM r QUALIFY ROW_NUMBER() OVER
  (PARTITION BY protocolo ORDER BY event_id % 3 DESC, event_id DESC) = 1""", r=_RAW_SQL)


def keyed_merge(spark, sf):
    """Old and new rows by key, and the rows whose key is not there yet."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", F.lit("old").alias("src"))
    new = o.filter("o_orderkey % 3 = 0").withColumns(
        {"o_orderkey": C("o_orderkey") + 6, "src": F.lit("new")})
    merged = dedup.keyed_merge(o, new, "o_orderkey", [F.desc("o_totalprice")])
    fresh = dedup.not_yet_processed(new, o, "o_orderkey").withColumn("src", F.lit("fresh"))
    return merged.unionByName(fresh)


MERGE_SQL = """WITH n AS (SELECT o_orderkey + 6 AS o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 3 = 0)
SELECT COALESCE(n.o_orderkey, o.o_orderkey) AS o_orderkey, COALESCE(n.o_totalprice, o.o_totalprice) AS o_totalprice,
  CASE WHEN n.o_orderkey IS NULL THEN 'old' ELSE 'new' END AS src FROM orders o FULL JOIN n ON n.o_orderkey = o.o_orderkey
UNION ALL SELECT o_orderkey, o_totalprice, 'fresh' FROM n WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders)"""


def keep_last(spark, sf):
    """Last row per key in source order."""
    e = table(spark, sf, "events").withColumn("key", C("user_id").cast("string"))
    return dedup.keep_last(e, "key", ["event_id"]).select("key", "event_id", "event_type")


# --- audits -------------------------------------------------------------------------

def _with_sla(spark, sf):
    return requests(spark, sf).withColumn("SLA_Interacoes_Regulacao", C("numeroCMCE") % 17)


def integrity_audit(spark, sf):
    """Volume, retired columns, SLA means."""
    return audit.integrity_audit(_with_sla(spark, sf).withColumn("Risco Cor", F.lit("x")))


INTEGRITY_SQL = duck("""SELECT COUNT(*) AS total, ROUND(AVG("SLA_Lead_Time_Total_Dias"), 1) AS media_lead_time_dias,
  CAST(MAX("numeroCMCE" % 17) AS INTEGER) AS maximo_ping_pong,
  COUNT(*) FILTER (WHERE "SLA_Desfecho_Atingido" = true) AS qtd_casos_encerrados, COUNT(*) > 0 AS not_empty,
  'Risco Cor' AS legacy_columns FROM v""", v=REQUESTS)


def first_rows(spark, sf):
    """Three rows with a specialty."""
    return audit.snapshot_sample(requests(spark, sf))


def schema_checks(spark, sf):
    """Missing required and present retired columns of two frames."""
    r = requests(spark, sf)
    bad = r.drop("dataCadastro").withColumn("Protocolo", C("numeroCMCE"))
    rows = [(name, ", ".join(contract.missing_columns(df)), ", ".join(contract.legacy_columns(df)))
            for name, df in [("good", r), ("bad", bad)]]
    checks = F.array(*[F.struct(F.lit(n).alias("frame"), F.lit(m).alias("missing"), F.lit(g).alias("legacy"))
                       for n, m, g in rows])
    return r.agg(F.count(F.lit(1)).alias("n")).select("n", F.inline(checks))


def freshness(spark, sf):
    """Age of the newest file of a dataset against the two-hour limit."""
    path = scratch_dir(spark, "fresh")
    files.write_parquet(table(spark, sf, "part"), path)
    df = spark.read.parquet(path)
    now = audit.freshness(df, "2100-01-01").select(F.lit("late").alias("clock"), (C("age_hours") > 2).alias("old"), "stale")
    early = audit.freshness(df, "2000-01-01").select(F.lit("early").alias("clock"), (C("age_hours") > 2).alias("old"), "stale")
    return now.unionByName(early)


_RUNS_SQL = """SELECT CAST(epoch(date_trunc('day', ts)) AS DOUBLE) AS timestamp, COUNT(*) AS items_ingested,
  COUNT(*) FILTER (event_type = 'error') AS items_failed FROM events GROUP BY 1"""


def run_log_last(spark, sf):
    """Run log rows per day of events, appended in batches, newest five."""
    path = scratch_dir(spark, "runs")
    e = table(spark, sf, "events")
    daily = e.groupBy(F.unix_timestamp(F.date_trunc("day", C("ts").cast("timestamp"))).cast("double").alias("timestamp")).agg(
        F.count(F.lit(1)).alias("items_ingested"), F.count_if(C("event_type") == "error").alias("items_failed"))
    share = C("items_failed") / C("items_ingested")
    status = (F.when((C("items_ingested") >= DEFAULT_RULES.breaker_min_rows) & (share > 0.22), stores.CIRCUIT_BREAKER)
              .when(C("items_failed") > 0, stores.PARTIAL).otherwise(stores.SUCCESS))
    runs = daily.withColumns({"duration_seconds": C("items_ingested") / 2.0, "status": status,
                              "bytes_processed": F.lit(0).cast("bigint"), "error_message": F.lit(""),
                              "target_lists": F.array(F.lit("filaDeEspera"))})
    runs.filter("timestamp % 172800 = 0").write.mode("append").parquet(path)
    runs.filter("timestamp % 172800 <> 0").write.mode("append").parquet(path)
    return stores.last_runs(spark.read.parquet(path), 5).select(
        "timestamp", "duration_seconds", "status", "items_ingested", "items_failed",
        F.to_json("target_lists").alias("target_lists"))


RUNS_SQL = duck("""SELECT timestamp, items_ingested / 2.0::DOUBLE AS duration_seconds,
  CASE WHEN items_ingested >= 100 AND items_failed / items_ingested > 0.22 THEN 'CIRCUIT_BREAKER'
    WHEN items_failed > 0 THEN 'PARTIAL' ELSE 'SUCCESS' END AS status, items_ingested, items_failed,
  '["filaDeEspera"]' AS target_lists FROM r ORDER BY timestamp DESC LIMIT 5""", r=_RUNS_SQL)


def raw_store_rows(spark, sf):
    """Store rows of captured documents, corrupt ones left out, keyless ones keyed."""
    rows = stores.raw_rows(_damaged(spark, sf))
    return rows.select(F.when(C("protocolo").startswith(stores.NO_KEY), "generated").otherwise(C("protocolo"))
                       .alias("protocolo"), "data_alteracao", "origem_lista")


RAW_STORE_SQL = f"""WITH d AS ({DOC_DUCK}) SELECT CASE WHEN CAST(cmce AS BIGINT) % 12 = 1 THEN 'generated'
  ELSE cmce END AS protocolo, t3 AS data_alteracao, pr AS origem_lista FROM d
  WHERE CAST(cmce AS BIGINT) % 12 NOT IN (3, 4, 9)"""


def record_lines_query(spark, sf):
    """records turned on their side."""
    return record_lines(table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey"), "s_suppkey")


STORED_VERSION = T.StructType([T.StructField("user", T.LongType()), T.StructField("event_id", T.LongType()),
                              T.StructField("kind", T.StringType()), T.StructField("stamp", T.LongType())])


def _version_store(spark, sf):
    """Events as versions of their users, written in nine batches (the third one twice) and merged twice on the way."""
    store = KeyedStore(scratch_dir(spark, "versions"), STORED_VERSION, ("user",), newest=("stamp", "event_id"),
                       group="kind", stamp="stamp", buckets=4)
    e = table(spark, sf, "events").select(C("user_id").alias("user"), "event_id", C("event_type").alias("kind"),
                                          F.unix_millis(C("ts").cast("timestamp")).alias("stamp"))
    for n, batch in enumerate([0, 1, 2, 2, 3, 4, 5, 6, 7, 8]):
        store.append(e.filter(C("event_id") % 9 == batch), batch)
        if n in (4, 8):
            store.compact(spark, most_runs=3)
    return store


def store_versions(spark, sf):
    """Newest version per key of a store that was merged in between, looked up for every seventh key."""
    store = _version_store(spark, sf)
    keys = table(spark, sf, "events").filter("user_id % 7 = 0").select(C("user_id").alias("user"))
    found = store.current(spark, keys).select("user", "event_id", "kind", F.lit(True).alias("looked_up"))
    return found.unionByName(store.current(spark).select("user", "event_id", "kind", F.lit(False).alias("looked_up")))


VERSIONS_SQL = """WITH newest AS (SELECT user_id AS "user", event_id, event_type AS kind FROM events
  QUALIFY ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY epoch_ms(ts) DESC, event_id DESC) = 1)
SELECT *, FALSE AS looked_up FROM newest UNION ALL SELECT *, TRUE FROM newest WHERE "user" % 7 = 0"""


def store_figures(spark, sf):
    """Highest stamp and last batch per group from the manifest, after merges."""
    return _version_store(spark, sf).figures(spark).select(C("grp").alias("kind"), "max_stamp", "last_batch")


QUERIES = {
    "scan_view": (scan_view, "SELECT o_orderstatus, COUNT(*) AS n FROM orders WHERE o_totalprice > 100000 GROUP BY 1"),
    "row_count": (row_count, "SELECT COUNT(*) AS n FROM lineitem"),
    "schema_table": (schema_table, SCHEMA_SQL),
    "lineage_cols": (lineage_cols, "SELECT 'part.parquet' AS source_file, COUNT(*) AS n, COUNT(*) AS stamped FROM part"),
    "parquet_roundtrip": (parquet_roundtrip, "SELECT * REPLACE (CAST(p_size + 1 AS INTEGER) AS p_size) FROM part"),
    "csv_roundtrip": (csv_roundtrip, "SELECT doc_id, lang, md5(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS text FROM documents"),
    "csv_quoted_roundtrip": (csv_quoted_roundtrip, "SELECT conv_id, turn, role, md5(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS text FROM conversations"),
    "column_files": (column_files, COLUMN_SQL),
    "consolidate": (consolidate, CONS_SQL),
    "bad_file_skip": (bad_file_skip, """SELECT COUNT(*) AS n, COUNT(*) AS dated, 'loaded' AS kind FROM orders
        UNION ALL SELECT CAST(MIN(1) AS BIGINT), CAST(MIN(1) AS BIGINT), 'skipped reasons' FROM orders"""),
    "union_by_name": (union_by_name, """SELECT o_orderkey, o_orderstatus, o_totalprice, CAST(NULL AS BIGINT) AS o_custkey
        FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, NULL, o_totalprice, o_custkey FROM orders
        WHERE o_orderkey % 2 = 1"""),
    "typed_cleanup": (typed_cleanup, TYPED_SQL),
    "canonical_projection": (canonical_projection, duck(
        """SELECT situacao, '' AS "corRegulador", "numeroCMCE",
        historico_quadro_clinico || ' fim  .' AS historico_quadro_clinico FROM v""", v=REQUESTS)),
    "drop_and_rename": (drop_and_rename, """SELECT c_custkey, c_name AS "Nome", c_nationkey,
        c_mktsegment AS "Origem (Lista)" FROM customer"""),
    "watermark_by_list": (watermark_by_list, duck(
        "SELECT origem_lista, COALESCE(MAX(data_alteracao), 0) AS watermark FROM r GROUP BY 1", r=_RAW_SQL)),
    "incremental_cut": (incremental_cut, CUT_SQL),
    "upsert_latest": (upsert_latest, UPSERT_SQL),
    "store_versions": (store_versions, VERSIONS_SQL),
    "store_figures": (store_figures, """SELECT event_type AS kind, CAST(MAX(epoch_ms(ts)) AS BIGINT) AS max_stamp,
        CAST(MAX(event_id % 9) AS BIGINT) AS last_batch FROM events GROUP BY 1"""),
    "keyed_merge": (keyed_merge, MERGE_SQL),
    "keep_last": (keep_last, """SELECT CAST(user_id AS VARCHAR) AS key, event_id, event_type FROM events
        QUALIFY ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1"""),
    "integrity_audit": (integrity_audit, INTEGRITY_SQL),
    "first_rows": (first_rows, duck("""SELECT "numeroCMCE", entidade_especialidade_descricao AS especialidade,
        "entidade_classificacaoRisco_cor" AS risco FROM v WHERE entidade_especialidade_descricao IS NOT NULL
        AND entidade_especialidade_descricao <> '' ORDER BY 1 LIMIT 3""", v=REQUESTS)),
    "schema_checks": (schema_checks, """SELECT COUNT(*) AS n, 'good' AS frame, '' AS missing, '' AS legacy FROM orders
        UNION ALL SELECT COUNT(*), 'bad', 'dataCadastro', 'Protocolo' FROM orders"""),
    "freshness": (freshness, """SELECT 'late' AS clock, COUNT(*) > 0 AS "old", COUNT(*) > 0 AS stale FROM part
        UNION ALL SELECT 'early', COUNT(*) < 0, COUNT(*) < 0 FROM part"""),
    "run_log_last": (run_log_last, RUNS_SQL),
    "raw_store_rows": (raw_store_rows, RAW_STORE_SQL),
    "record_lines": (record_lines_query, """SELECT s_suppkey, 's_name' AS "column", s_name AS value FROM supplier
        UNION ALL SELECT s_suppkey, 's_nationkey', CAST(s_nationkey AS VARCHAR) FROM supplier"""),
}
