"""Keyed stores: replays, crashes, merges, lookups that skip pages, state without data files."""

import random

import pytest
from helpers import doc, land, stage_totals
from pyspark.sql import functions as F, types as T

from queuelens.operators.history import ownership
from queuelens.schema import REQUEST_SCHEMA
from queuelens.sources.runs import KeyedStore
from queuelens.streaming import ingest, ownership as own

C = F.col
ROW = T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.StringType()), T.StructField("s", T.LongType()),
                    T.StructField("g", T.StringType())])


@pytest.fixture
def store(tmp_path):
    return KeyedStore(str(tmp_path / "store"), ROW, ("k",), newest=("s", "batch_id"), group="g", stamp="s", buckets=3)


def rows_of(spark, rows):
    return spark.createDataFrame(rows, ROW)


def newest(batches):
    best = {}
    for n, rows in enumerate(batches):
        for k, v, s, g in rows:
            if k not in best or (s or -1, n) >= best[k][0]:
                best[k] = ((s or -1, n), v)
    return {k: v for k, (_, v) in best.items()}


def test_newest_version_through_merges_and_replays(spark, store):
    rng = random.Random(6)
    batches = []
    for n in range(14):
        keys = rng.sample(range(60), 12)
        batches.append([(None if k == 59 else k, f"{n}/{k}", rng.choice([None, n, 20 - n]), rng.choice(["a", "b", None])) for k in keys])
        store.append(rows_of(spark, batches[-1]), n)
        if n in (4, 9):
            store.append(rows_of(spark, batches[-1]), n)  # a replay
        if n in (6, 11):
            assert store.compact(spark, most_runs=2)
            store.append(rows_of(spark, batches[3]), 3)  # a replay of a merged batch changes nothing
        got = {r.k: r.v for r in store.current(spark).collect()}
        assert got == newest(batches), n
    wanted = rows_of(spark, [(k, "", 0, "") for k in (1, 5, 9, 59, 400, None)]).select("k")
    expected = {k: v for k, v in newest(batches).items() if k in (1, 5, 9, 59, None)}
    assert {r.k: r.v for r in store.current(spark, wanted).collect()} == expected
    figures = {r.grp: (r.max_stamp, r.last_batch) for r in store.figures(spark).collect()}
    for g in ("a", "b", None):
        mine = [(s or 0, n) for n, rows in enumerate(batches) for _, _, s, group in rows if group == g]
        assert figures[g] == (max(s for s, _ in mine), max(n for _, n in mine))
    before = store.current(spark).count()
    assert store.vacuum(spark) > 0 and store.vacuum(spark) == 0 and store.current(spark).count() == before


def test_runs_per_bucket_stay_few(spark, tmp_path):
    store = KeyedStore(str(tmp_path / "s"), ROW, ("k",), buckets=1)
    most = 0
    for n in range(12):
        store.append(rows_of(spark, [(n * 4 + i, "x", n, "a") for i in range(4)]), n)
        store.compact(spark, most_runs=2, keep_all=True)
        most = max(most, *map(len, store.live(spark).values()))
    assert most <= 5 and store.read(spark).count() == 48


def test_a_crash_between_steps_leaves_the_last_good_state(spark, store, monkeypatch):
    store.append(rows_of(spark, [(1, "old", 1, "a")]), 0)
    enter = KeyedStore._enter

    def crash(*_):
        raise RuntimeError("lost")
    monkeypatch.setattr(KeyedStore, "_enter", crash)
    for batch in (0, 1):  # a try of a stored batch again, and of a new one
        with pytest.raises(RuntimeError):
            store.append(rows_of(spark, [(1, "new", 2, "a")]), batch)
    with pytest.raises(RuntimeError):
        store._write(store.read(spark), "c1", {b: ["b0"] for b in range(3)})
    assert [r.v for r in store.current(spark).collect()] == ["old"] and store.figures(spark).first().max_stamp == 1
    monkeypatch.setattr(KeyedStore, "_enter", enter)
    store.append(rows_of(spark, [(1, "new", 2, "a")]), 1)
    assert [r.v for r in store.current(spark).collect()] == ["new"] and store.vacuum(spark) == 3


def test_empty_stores_and_batches(spark, store):
    assert store.current(spark).count() == 0 and store.figures(spark).count() == 0 and store.compact(spark) == []
    store.append(rows_of(spark, []), 0)
    assert store.current(spark).count() == 0 and store.read(spark, rows_of(spark, []).select("k")).count() == 0


def test_lookups_skip_pages(spark, tmp_path):
    store = KeyedStore(str(tmp_path / "s"), ROW, ("k",), buckets=2)
    store.append(spark.range(400_000).select(C("id").alias("k"), F.md5(C("id").cast("string")).alias("v"), C("id").alias("s"),
                                             F.lit("a").alias("g")), 0)
    whole, all_bytes, _ = stage_totals(spark, lambda: store.read(spark).agg(F.max("v"), F.sum("s")).first())
    keys = spark.range(20).select((C("id") * 20_011 % 400_000).alias("k"))
    found, some_bytes, _ = stage_totals(spark, lambda: store.read(spark, keys).agg(F.count("v"), F.max("v")).first())
    assert found[0] == 20 and some_bytes < 0.5 * all_bytes


def test_state_of_the_ingest_opens_no_data_file(spark, tmp_path):
    landing, paths = str(tmp_path / "in"), ingest.IngestPaths(str(tmp_path / "out"))
    for n in range(3):
        land(spark, landing, [doc(k, f"v{n}", dataAlterouUltimaSituacao=10 * n + k) for k in range(1, 5)])
        ingest.ingest(spark, landing, paths, "2024-06-01", "s")
    for frame in (ingest.resume_state(spark, paths), ingest._marks(spark, paths)):
        assert not any("/requests/runs/" in f or "/raw/" in f for f in frame.inputFiles())
    state = ingest.resume_state(spark, paths).first()
    assert (state.watermark, state.last_batch, state.full_sync_completed) == (24, 2, True)
    ingest.maintain(spark, paths, most_runs=1)
    state = ingest.resume_state(spark, paths).first()
    assert (state.watermark, state.last_batch) == (24, 2)
    assert {len(runs) for runs in ingest.request_store(paths).live(spark).values()} == {1}
    rows = ingest.current_requests(spark, paths)
    assert rows.schema.simpleString() == REQUEST_SCHEMA.simpleString()
    assert {r.numeroCMCE: r.situacao for r in rows.collect()} == {str(k): "v2" for k in range(1, 5)}
    one = spark.createDataFrame([("3",)], "numeroCMCE string")
    assert [r.numeroCMCE for r in ingest.current_requests(spark, paths, one).collect()] == ["3"]


EVENT = "request int, ms long, seq int, state string, actor string"
STATES = ["AGUARDA_REGULACAO", "AUTORIZADA", "PENDENTE", "EM_ANALISE", "AGENDADA"]


def events_of(spark, rows):
    return spark.createDataFrame(rows, EVENT).withColumn("ts", F.timestamp_millis("ms")).drop("ms")


def test_streamed_ownership_equals_a_whole_fold(spark, tmp_path):
    rng = random.Random(8)
    base, day = str(tmp_path / "own"), 86_400_000
    rows = [(rng.randint(0, 9), rng.randint(0, 200) * day + rng.randint(0, 5), i, rng.choice([*STATES, *STATES, "REALIZADA"]), f"a{i % 4}")
            for i in range(240)]
    rng.shuffle(rows)  # late events and late final states in every batch
    for n in range(6):
        own.update(events_of(spark, rows[n * 40:n * 40 + 40]), n, base, "2024-06-01")
        if n in (2, 4):
            own.update(events_of(spark, rows[n * 40:n * 40 + 40]), n, base, "2024-06-01")
            own.maintain(spark, base, events_of(spark, rows[:1]).schema, most_runs=2)
        want = sorted(map(tuple, ownership(events_of(spark, rows[:n * 40 + 40]), "2024-06-01").collect()), key=repr)
        got = own.current(spark, base, events_of(spark, rows[:1]).schema)
        assert sorted(map(tuple, got.collect()), key=repr) == want


def test_a_batch_reads_the_same_while_history_grows(spark, tmp_path):
    """Twenty times the events, ten times the past of each request; the batch has late events as well."""
    day = 86_400_000
    read = {}
    for name, requests, events in (("short", 2_000, 2), ("long", 4_000, 20)):
        base = str(tmp_path / name)
        past = spark.range(requests * events).select(
            (C("id") % requests).cast("int").alias("request"),
            F.timestamp_millis(C("id") / requests * 10 * day).alias("ts"), C("id").cast("int").alias("seq"),
            F.when(C("id") % 2 == 0, "AGUARDA_REGULACAO").otherwise("PENDENTE").alias("state"), F.lit("a").alias("actor"))
        own.update(past, 0, base, "2024-06-01")
        batch = events_of(spark, [(r * 13, t * day, 10_000_000 + r, "AUTORIZADA", "b") for r in range(40) for t in (3, 15)])
        own.update(batch, 1, base, "2024-06-01")
        _, read[name], _ = stage_totals(spark, lambda: own.update(batch, 1, base, "2024-06-01"))
    assert read["long"] < 2.5 * read["short"], read
