"""Streams over the event table; each is drained and its result read back."""

from __future__ import annotations

import time
from dataclasses import replace

from pyspark.errors import StreamingQueryException
from pyspark.sql import Window, functions as F

from ..rules import DEFAULT_RULES
from ..session import scratch_dir
from ..sources import stores
from ..streaming import alerts, ingest, ownership, register
from ..streaming.run import drain, to_table
from .history import OWNERSHIP_SQL
from .records import AS_OF, DOC_DUCK, SALT, documents
from .views import AS_OF_EVENTS, history, table

C = F.col


def _stream(spark, sf):
    """The event file as a stream with a zoned timestamp and a list number."""
    schema = table(spark, sf, "events").schema
    # a pattern, because a stream takes a plain path for a folder
    raw = spark.readStream.schema(schema).parquet(f"{sf}/events.parquet*")
    return raw.withColumns({"ts": C("ts").cast("timestamp"), "lista": C("user_id") % 3})


def _minute(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm")


def stream_sliding_errors(spark, sf):
    """Sliding error rate per list."""
    path = scratch_dir(spark, "sliding")
    to_table(alerts.error_rate(_stream(spark, sf), C("event_type") == "error", "lista"), path)
    return spark.read.parquet(path).select(_minute("start").alias("start"), "lista", "n", "errors", "alert")


SLIDING_SQL = """WITH w AS (SELECT unnest([0, 5, 10]) AS back), e AS (SELECT user_id % 3 AS lista, event_type,
  time_bucket(INTERVAL 5 MINUTE, ts) - to_minutes(back) AS start FROM events, w)
SELECT strftime(start, '%Y-%m-%d %H:%M') AS start, lista, COUNT(*) AS n,
  COUNT(*) FILTER (event_type = 'error') AS errors, COUNT(*) FILTER (event_type = 'error') / COUNT(*) > 0.1 AS alert
FROM e GROUP BY 1, 2"""


def stream_late_rows(spark, sf):
    """I8: the newer half of the events first (its newest part ahead), then the older one; with
    a watermark of three quarters of the span, the oldest windows are closed by then and
    their rows dropped. Spark drops late rows by the watermark of the batch before."""
    base = scratch_dir(spark, "late")
    e = table(spark, sf, "events").withColumns({"ts": C("ts").cast("timestamp"), "lista": C("user_id") % 3})
    at = F.unix_micros("ts")
    first, last = e.agg(F.min(at), F.max(at)).first()
    middle = (first + last) // 2
    newest = (middle + last) // 2
    for part in (at >= newest, (at >= middle) & (at < newest), at < middle):
        e.filter(part).write.mode("append").parquet(f"{base}/landing")
        time.sleep(1.1)  # file times have seconds; the source takes files by time
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/landing")
    rate = alerts.error_rate(stream, C("event_type") == "error", "lista", f"{(last - first) * 3 // 4_000_000} seconds",
                             size="1 day", slide="1 day")
    to_table(rate, f"{base}/rates", "update")
    figures = F.max_by(F.struct("n", "errors", "alert"), "part").alias("x")  # an update replaces the window's figures
    return spark.read.parquet(f"{base}/rates").groupBy("start", "lista").agg(figures).select(
        _minute("start").alias("start"), "lista", "x.*")


LATE_SQL = """WITH s AS (SELECT epoch_us(MIN(ts)) AS a, epoch_us(MAX(ts)) AS b FROM events),
  e AS (SELECT *, user_id % 3 AS lista, date_trunc('day', ts) AS start FROM events)
SELECT strftime(start, '%Y-%m-%d %H:%M') AS start, lista, COUNT(*) AS n,
  COUNT(*) FILTER (event_type = 'error') AS errors, COUNT(*) FILTER (event_type = 'error') / COUNT(*) > 0.1 AS alert
FROM e, s WHERE epoch_us(ts) >= (a + b) // 2
  OR epoch_us(start + INTERVAL 1 DAY) > b - ((b - a) * 3 // 4000000) * 1000000 GROUP BY 1, 2"""


def stream_tumbling_p90(spark, sf):
    """P90 per hour."""
    path = scratch_dir(spark, "p90")
    to_table(alerts.duration_p90(_stream(spark, sf), "value", limit=30.0), path)
    return spark.read.parquet(path).select(_minute("start").alias("start"), "n", "p90", "alert")


P90_SQL = """SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, COUNT(*) AS n,
  list_sort(list(value))[CAST(ceil(0.9 * COUNT(*)) AS BIGINT)] AS p90,
  list_sort(list(value))[CAST(ceil(0.9 * COUNT(*)) AS BIGINT)] > 30.0 AS alert FROM events GROUP BY 1"""


def stream_counters(spark, sf):
    """Counters by day, type, list and duration bucket."""
    path = scratch_dir(spark, "counters")
    to_table(alerts.counters(_stream(spark, sf), "event_type", "lista", "value"), path)
    return spark.read.parquet(path).select(_minute("start").alias("start"), "event_type", "lista", "bucket", "n",
                                           F.round("seconds", 4).alias("seconds"))


COUNTERS_SQL = """SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M') AS start, event_type, user_id % 3 AS lista,
  CASE WHEN value <= 1 THEN '1.0' WHEN value <= 5 THEN '5.0' WHEN value <= 10 THEN '10.0' WHEN value <= 30 THEN '30.0'
    WHEN value <= 60 THEN '60.0' WHEN value <= 120 THEN '120.0' WHEN value <= 240 THEN '240.0' ELSE '+Inf' END AS bucket,
  COUNT(*) AS n, ROUND(SUM(value), 4) AS seconds FROM events GROUP BY 1, 2, 3, 4"""


def stream_heartbeat(spark, sf):
    """Heartbeat, freshness, stall and high-risk flags."""
    path = scratch_dir(spark, "heartbeat")
    to_table(alerts.last_seen(_stream(spark, sf), "lista", C("event_type") == "purchase", C("value") > 20), path)
    beat = alerts.heartbeat(spark.read.parquet(path), "2024-01-31 02:00:00")
    return beat.select("lista", "high_risk", "stale", "not_fresh", "stalled", "risk_surge")


HEARTBEAT_SQL = """WITH s AS (SELECT user_id % 3 AS lista, MAX(ts) AS t, MAX(ts) FILTER (event_type = 'purchase') AS ok,
  COUNT(*) FILTER (value > 20) AS high_risk FROM events GROUP BY 1)
SELECT lista, high_risk, TIMESTAMP '2024-01-31 02:00:00' - ok > INTERVAL 100000 SECOND AS stale,
  TIMESTAMP '2024-01-31 02:00:00' - t > INTERVAL 2 HOUR AS not_fresh,
  TIMESTAMP '2024-01-31 02:00:00' - ok >= INTERVAL 6 HOUR AS stalled, high_risk > 500 AS risk_surge FROM s"""


def _register_stream(spark, sf):
    """Register messages made from the event stream; every message comes twice."""
    s = _stream(spark, sf)
    crm = F.when(C("event_id") % 4 == 0, None).otherwise(F.struct(
        F.when(C("event_id") % 10 == 1, "00000").when(C("event_id") % 10 == 3, "12x")
        .otherwise(C("user_id").cast("string")).alias("crm_numero"),
        F.when(C("event_id") % 14 == 2, "R1").otherwise("rs").alias("crm_uf")))
    value = F.to_json(F.struct(
        C("event_id").cast("string").alias("id"),
        F.when(C("event_type") == "signup", "REGISTER").otherwise("LOGIN").alias("type"),
        C("user_id").cast("string").alias("userId"), crm.alias("details")))
    messages = s.select(value.alias("value"), C("ts").alias("timestamp"))
    return messages.union(messages)


def stream_dedup(spark, sf):
    """Every event id once."""
    path = scratch_dir(spark, "dedup")
    to_table(register.distinct_events(_register_stream(spark, sf), "60 days"), path, "append")
    return spark.read.parquet(path).groupBy("type").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("ids"))


def dead_letter_sink(spark, sf):
    """Register events split into profiles and dead letters."""
    path = scratch_dir(spark, "register")

    def write(batch, batch_id):
        good, dead = register.split(batch, blocked=("00000",))
        stores.append_batch(good, f"{path}/profiles", batch_id)
        stores.append_batch(dead, f"{path}/dead", batch_id)

    drain(register.registrations(register.distinct_events(_register_stream(spark, sf), "60 days")), write)
    good = spark.read.parquet(f"{path}/profiles").select("id", F.lit("profile").alias("kind"))
    dead = spark.read.parquet(f"{path}/dead").select(
        F.get_json_object("original_payload", "$.id").alias("id"), C("error").alias("kind"))
    return good.unionByName(dead)


DEAD_SQL = f"""SELECT CAST(event_id AS VARCHAR) AS id, CASE WHEN event_id % 4 <> 0 AND (event_id % 10 IN (1, 3)
  OR event_id % 14 = 2) THEN '{register.FAILED}' ELSE 'profile' END AS kind FROM events WHERE event_type = 'signup'"""


def _land(docs, path, max_rows=None):
    """Write documents as compressed landing files, each key in one file and in the order of ``order``."""
    writer = (docs.repartition("key").sortWithinPartitions("key", "order").select("conteudo_json", "origem_lista").write
              .option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED"))
    (writer.option("maxRecordsPerFile", max_rows) if max_rows else writer).mode("append").json(path)


def landing_stream(spark, sf):
    """All documents from a landing folder into the stores, in several batches."""
    base = scratch_dir(spark, "ingest")
    key = C("protocolo").cast("bigint")
    docs = documents(spark, sf).withColumn("conteudo_json", F.when(key % 80 == 3, "not json").when(
        key % 160 == 23, F.concat(F.lit('{"situacao":"A","evolucoes":null,"numeroCMCE":'), "protocolo", F.lit("}")))
        .otherwise(C("conteudo_json")))
    _land(docs.withColumns({"key": C("protocolo"), "order": F.lit(0)}), f"{base}/landing")
    paths = ingest.IngestPaths(f"{base}/stores")
    ingest.ingest(spark, f"{base}/landing", paths, AS_OF, SALT, max_files=3)
    good = ingest.current_requests(spark, paths).select(
        C("numeroCMCE").alias("key"), "origem_lista", C("SLA_Tipo_Desfecho").alias("result"))
    dead = ingest.dead_letters(spark, paths).select(
        F.lit("dead").alias("key"), "origem_lista", F.array_join("errors", "; ").alias("result"))
    return good.unionByName(dead)


LANDING_SQL = f"""WITH d AS ({DOC_DUCK}), m AS (SELECT *, CAST(cmce AS BIGINT) AS r FROM d)
SELECT cmce AS key, pr AS origem_lista, CASE WHEN st <> 'F' THEN '' WHEN s2 = 'REALIZADA' THEN 'POSITIVO'
  WHEN s2 = 'CANCELADA' THEN 'NEGATIVO' ELSE 'ABANDONO' END AS result FROM m WHERE r % 80 <> 3 AND r % 160 <> 23
UNION ALL SELECT 'dead', pr, CASE WHEN r % 80 = 3 THEN 'payload: corrupt' ELSE 'evolucoes: null' END FROM m
  WHERE r % 80 = 3 OR r % 160 = 23"""


def _small_docs(rows, key, state, stamp, list_name, order, bad=None):
    """Documents with an empty history: (key, order, conteudo_json, origem_lista)."""
    text = F.to_json(F.struct(key.alias("numeroCMCE"), state.alias("situacao"),
                              stamp.alias("dataAlterouUltimaSituacao"), F.array().alias("evolucoes")))
    text = text if bad is None else F.when(bad, "{}").otherwise(text)
    return rows.select(key.alias("key"), order.alias("order"), text.alias("conteudo_json"), list_name.alias("origem_lista"))


def ingest_duplicate_keys(spark, sf):
    """Three versions of every request within one batch; the newest one counts.

    Every third key has its highest stamp on the second version, the others have no stamp
    or the same one on all versions, so there the last in the source wins.
    """
    base = scratch_dir(spark, "duplicates")
    k = C("o_orderkey")
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", F.explode(
        F.sequence(F.lit(1), F.lit(3))).alias("v"))
    stamp = F.when(k % 3 == 0, F.when(C("v") == 2, 9000).otherwise(C("v") * 1000)).when(k % 3 == 1, 5000)
    _land(_small_docs(rows, k, F.concat(F.lit("S"), C("v")), stamp, C("o_orderpriority"), C("v")), f"{base}/landing")
    paths = ingest.IngestPaths(f"{base}/stores")
    ingest.ingest(spark, f"{base}/landing", paths, AS_OF, SALT)
    return ingest.current_requests(spark, paths).select("numeroCMCE", "situacao", "origem_lista")


def ingest_incremental(spark, sf):
    """A second run takes in only what lies above the watermark of its list."""
    base = scratch_dir(spark, "incremental")
    o = table(spark, sf, "orders")
    day = F.unix_millis(C("o_orderdate").cast("timestamp"))
    paths = ingest.IngestPaths(f"{base}/stores")
    first = _small_docs(o.filter("o_orderkey % 2 = 0"), C("o_orderkey"), F.lit("A"), day, C("o_orderpriority"), F.lit(0))
    _land(first, f"{base}/landing")
    ingest.ingest(spark, f"{base}/landing", paths, AS_OF, SALT)
    later = day + (C("o_orderkey") % 5) * 86_400_000 * 700
    second = _small_docs(o, C("o_orderkey"), F.lit("B"), later, C("o_orderpriority"), F.lit(0))
    _land(second, f"{base}/landing")
    ingest.ingest(spark, f"{base}/landing", paths, AS_OF, SALT)
    state = ingest.resume_state(spark, paths).select(
        C("origem_lista").alias("numeroCMCE"), F.when(C("full_sync_completed"), "synced").alias("situacao"), "watermark")
    return ingest.current_requests(spark, paths).select(
        "numeroCMCE", "situacao", F.lit(0).cast("bigint").alias("watermark")).unionByName(state)


INCREMENTAL_SQL = """WITH o AS (SELECT *, epoch_ms(o_orderdate) AS t, epoch_ms(o_orderdate)
    + (o_orderkey % 5) * 86400000::BIGINT * 700 AS t2 FROM orders),
  m AS (SELECT o_orderpriority, MAX(t) AS wm FROM o WHERE o_orderkey % 2 = 0 GROUP BY 1),
  j AS (SELECT o.*, t2 > wm AS fresh FROM o JOIN m USING (o_orderpriority))
SELECT CAST(o_orderkey AS VARCHAR) AS "numeroCMCE", CASE WHEN fresh THEN 'B' ELSE 'A' END AS situacao,
  CAST(0 AS BIGINT) AS watermark FROM j WHERE fresh OR o_orderkey % 2 = 0
UNION ALL SELECT o_orderpriority, 'synced', CAST(MAX(t2) AS BIGINT) FROM o GROUP BY 1"""


def ingest_breaker_small_batches(spark, sf):
    """Batches of fewer rows than the breaker needs; it counts over the run and opens."""
    base = scratch_dir(spark, "breaker")
    p = table(spark, sf, "part")
    docs = _small_docs(p, C("p_partkey"), F.lit("A"), C("p_partkey"), C("p_brand"), F.lit(0), C("p_partkey") % 5 == 0)
    _land(docs, f"{base}/landing", max_rows=20)
    paths = ingest.IngestPaths(f"{base}/stores")
    try:
        ingest.ingest(spark, f"{base}/landing", paths, AS_OF, SALT, max_files=1)
    except StreamingQueryException:
        pass  # the run log tells
    taken = ingest.current_requests(spark, paths).agg(F.count(F.lit(1)).alias("published"))
    run = stores.read_runs(spark, paths.runs)
    return run.select("status", (C("items_failed") < 60).alias("early"), F.regexp_replace(
        "error_message", "[0-9]+", "N").alias("message")).unionByName(
        taken.select(F.lit("published below 120").alias("status"), (C("published") < 120).alias("early"), F.lit("").alias("message")))


def ingest_run_log(spark, sf):
    """One row per run in all four states, through the ingest itself."""
    base = scratch_dir(spark, "run-log")
    p = table(spark, sf, "part")
    paths = ingest.IngestPaths(f"{base}/stores")
    tolerant = replace(DEFAULT_RULES, breaker_ratio=1.0)
    steps = [(None, DEFAULT_RULES, AS_OF), (C("p_partkey") % 50 == 0, DEFAULT_RULES, AS_OF),
             (C("p_partkey") % 2 == 0, DEFAULT_RULES, AS_OF), (False, tolerant, "no day"), (False, tolerant, AS_OF)]
    for n, (bad, rules, as_of) in enumerate(steps):
        if bad is not False:  # the last two runs meet the batch that the breaker left
            _land(_small_docs(p, C("p_partkey"), F.lit("A"), F.lit(n + 1), F.lit("fila"), F.lit(0), bad), f"{base}/landing")
        try:
            ingest.ingest(spark, f"{base}/landing", paths, as_of, SALT, rules)
        except StreamingQueryException:
            pass  # the run log tells
    runs = stores.last_runs(stores.read_runs(spark, paths.runs), 10)
    place = F.row_number().over(Window.orderBy("timestamp")).alias("run")  # five rows
    return runs.select(place, "status", "items_ingested", "items_failed",
                       F.to_json("target_lists").alias("target_lists"), (C("error_message") != "").alias("explained"))


RUN_LOG_SQL = """SELECT run, status, CASE run WHEN 1 THEN COUNT(*) WHEN 2 THEN COUNT(*) - COUNT(*) FILTER (p_partkey % 50 = 0)
    WHEN 5 THEN COUNT(*) - COUNT(*) FILTER (p_partkey % 2 = 0) ELSE 0 END AS items_ingested,
  CASE run WHEN 1 THEN 0 WHEN 2 THEN COUNT(*) FILTER (p_partkey % 50 = 0) ELSE COUNT(*) FILTER (p_partkey % 2 = 0) END
    AS items_failed, '["fila"]' AS target_lists, run IN (3, 4) AS explained
FROM part, (VALUES (1, 'SUCCESS'), (2, 'PARTIAL'), (3, 'CIRCUIT_BREAKER'), (4, 'FAILURE'), (5, 'PARTIAL')) r(run, status)
GROUP BY run, status"""


def stream_ownership(spark, sf):
    """Ownership figures after three micro-batches in no particular order."""
    base = scratch_dir(spark, "ownership")
    events = history(spark, sf)
    # three batches however many files: every batch meets all requests again, so the work of a file each would be quadratic
    each = -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // 3)
    events.repartition(3 * each, "seq").write.parquet(f"{base}/landing")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", each).parquet(f"{base}/landing")
    drain(stream, lambda batch, n: ownership.update(batch, n, f"{base}/state", AS_OF_EVENTS))
    return ownership.current(spark, f"{base}/state", events.schema).select(
        "request", "SLA_Tempo_Solicitante_Dias", "SLA_Tempo_Regulador_Dias", "SLA_Lead_Time_Total_Dias",
        "SLA_Interacoes_Regulacao", "SLA_Atores_Envolvidos")


QUERIES = {
    "stream_sliding_errors": (stream_sliding_errors, SLIDING_SQL),
    "stream_late_rows": (stream_late_rows, LATE_SQL),
    "stream_tumbling_p90": (stream_tumbling_p90, P90_SQL),
    "stream_counters": (stream_counters, COUNTERS_SQL),
    "stream_heartbeat": (stream_heartbeat, HEARTBEAT_SQL),
    "stream_dedup": (stream_dedup, """SELECT CASE WHEN event_type = 'signup' THEN 'REGISTER' ELSE 'LOGIN' END AS type,
        COUNT(*) AS n, COUNT(*) AS ids FROM events GROUP BY 1"""),
    "dead_letter_sink": (dead_letter_sink, DEAD_SQL),
    "landing_stream": (landing_stream, LANDING_SQL),
    "ingest_duplicate_keys": (ingest_duplicate_keys, """SELECT CAST(o_orderkey AS VARCHAR) AS "numeroCMCE",
        CASE WHEN o_orderkey % 3 = 0 THEN 'S2' ELSE 'S3' END AS situacao, o_orderpriority AS origem_lista FROM orders"""),
    "ingest_incremental": (ingest_incremental, INCREMENTAL_SQL),
    "ingest_breaker_small_batches": (ingest_breaker_small_batches, """SELECT 'CIRCUIT_BREAKER' AS status, COUNT(*) > 99 AS early,
        'N of N documents failed' AS message FROM part UNION ALL SELECT 'published below 120', COUNT(*) > 99, '' FROM part"""),
    "ingest_run_log": (ingest_run_log, RUN_LOG_SQL),
    "stream_ownership": (stream_ownership, OWNERSHIP_SQL),
}
