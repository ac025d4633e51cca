import time

from pyspark.sql import functions as F

from queuelens.streaming import alerts, register
from queuelens.streaming.run import to_table

C = F.col


def test_late_rows_are_dropped_and_open_windows_wait(spark, tmp_path):
    """Append mode: closed windows come out once, rows later than the watermark do not count."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in ([("2024-01-01 10:01:00", True), ("2024-01-01 10:02:00", False)], [("2024-01-03 00:00:00", False)],
                 # the late-row check lags one batch behind the watermark
                 [("2024-01-03 00:01:00", False)], [("2024-01-01 10:03:00", True)], [("2024-01-09 00:00:00", False)]):
        spark.createDataFrame([(t, "l", bad) for t, bad in rows], "t string, lista string, failed boolean").select(
            C("t").cast("timestamp").alias("ts"), "lista", "failed").coalesce(1).write.mode("append").parquet(source)
        time.sleep(1.1)
    schema = spark.read.parquet(source).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    rates = alerts.error_rate(stream, C("failed"), "lista", watermark="1 day", size="15 minutes", slide="15 minutes")
    to_table(rates, out, "append", str(tmp_path / "checkpoint"))
    got = {str(r.start): (r.n, r.errors, r.alert) for r in spark.read.parquet(f"{out}/*").collect()}
    assert got == {"2024-01-01 10:00:00": (2, 1, True), "2024-01-03 00:00:00": (2, 0, False)}


def test_duration_buckets_include_their_upper_bound(spark):
    df = spark.createDataFrame([(0.5,), (1.0,), (1.1,), (240.0,), (999.0,)], "d double")
    assert [r[0] for r in df.select(alerts.bucket(C("d"))).collect()] == ["1.0", "1.0", "5.0", "240.0", "+Inf"]


def test_heartbeat_flags(spark):
    df = spark.createDataFrame([("a", "2024-01-01 00:00:00", True), ("b", "2024-01-02 23:30:00", False)],
                               "lista string, t string, ok boolean").withColumn("ts", C("t").cast("timestamp"))
    beat = alerts.heartbeat(alerts.last_seen(df, "lista", C("ok"), ~C("ok")), "2024-01-03 00:00:00")
    got = {r.lista: (r.stale, r.not_fresh, r.stalled, r.risk_surge) for r in beat.collect()}
    assert got == {"a": (True, True, True, False), "b": (True, False, True, False)}


def test_registration_rules(spark):
    rows = [("1", "REGISTER", "12", "rs"), ("2", "REGISTER", "00000", "RS"), ("3", "REGISTER", None, None),
            ("4", "LOGIN", "1", "RS"), ("5", "REGISTER", "1x", "RS"), ("6", "REGISTER", "1", "R1")]
    events = spark.createDataFrame(rows, "id string, type string, n string, uf string").select(
        F.current_timestamp().alias("timestamp"), "id", "type", C("id").alias("userId"),
        F.struct(C("n").alias("crm_numero"), C("uf").alias("crm_uf")).alias("details"),
        F.lit("{}").alias("original_payload"))
    good, dead = register.split(register.registrations(events), blocked=("00000",))
    assert sorted(r.id for r in good.collect()) == ["1", "3"] and dead.count() == 3
