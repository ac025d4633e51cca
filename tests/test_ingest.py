import pytest
from helpers import doc, land
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from queuelens.plans import consolidate as cons
from queuelens.schema import DATE_COLUMNS, REQUEST_SCHEMA
from queuelens.sources import files, stores
from queuelens.streaming import ingest, ownership

C = F.col
NOW = "2024-06-01"


def test_csv_layouts_and_bad_files(spark, tmp_path):
    dates = ",".join(f'"{c}"' for c in DATE_COLUMNS)
    blank = ",".join('"01/02/2020"' for _ in DATE_COLUMNS)
    (tmp_path / "a.csv").write_text(f'"numeroCMCE",{dates},"cpf"\n"1",{blank},"x"\n"1",{blank},"line\nbreak"\n')
    (tmp_path / "b.csv").write_text(f'{dates},"numeroCMCE"\n{blank},"2"\n{blank}," "\n')
    (tmp_path / "c.csv").write_text('"numeroCMCE"\n"3"\n')
    (tmp_path / "d.csv").write_text("")
    rows, errors = files.load_csv(spark, f"{tmp_path}/*.csv")
    assert rows.count() == 4 and sorted(r.path[-5:] for r in errors.collect()) == ["c.csv", "d.csv"]
    kept = cons.anonymise(cons.clean(rows), "s", ["cpf", "absent"]).orderBy("numeroCMCE").collect()
    assert [r.numeroCMCE for r in kept] == ["1", "2"]
    assert kept[0].cpf == spark.range(1).select(F.sha2(F.lit("line\nbreaks"), 256)).first()[0]
    assert str(kept[0].dataCadastro) == "2020-02-01 00:00:00" and kept[1].cpf is None


def test_swap_in_replaces_its_own_source(spark, tmp_path):
    path = str(tmp_path / "t")
    files.ensure_dataset(spark, path, spark.range(1).schema)
    files.ensure_dataset(spark, path, spark.range(1).schema)
    assert spark.read.parquet(path).count() == 0
    files.swap_in(spark.range(5), path)
    files.swap_in(spark.read.parquet(path).filter("id > 2"), path)
    assert spark.read.parquet(path).count() == 2 and [p.name for p in tmp_path.iterdir()] == ["t"]


def test_replayed_batches_leave_no_duplicates(spark, tmp_path):
    path = str(tmp_path / "store")
    first = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int")
    second = spark.createDataFrame([("b", 2)], "k string, v int")
    for batch, df in [(0, first), (1, second), (0, first), (1, second)]:
        stores.append_batch(df, path, batch)
    assert spark.read.parquet(path).count() == 3
    assert {r.k: r.v for r in stores.latest(spark, path, "k").collect()} == {"a": 1, "b": 2}


def test_keyless_documents_get_a_stable_key(spark):
    df = spark.createDataFrame([('{"situacao": "A"}', "l")], "conteudo_json string, origem_lista string")
    a, b = (stores.raw_rows(df).first().protocolo for _ in range(2))
    assert a == b and a.startswith(stores.NO_KEY)


def test_ingest_run(spark, tmp_path):
    landing, paths = str(tmp_path / "in"), ingest.IngestPaths(str(tmp_path / "out"))
    land(spark, landing, [doc(1), doc(2), '{"situacao": "A"}', None])
    ingest.ingest(spark, landing, paths, NOW, "s")
    land(spark, landing, [doc(2, "B", dataAlterouUltimaSituacao=50)])
    ingest.ingest(spark, landing, paths, NOW, "s")
    rows = ingest.current_requests(spark, paths)
    assert rows.schema.simpleString() == REQUEST_SCHEMA.simpleString()
    assert {r.numeroCMCE: r.situacao for r in rows.collect()} == {"1": "A", "2": "B"}
    assert spark.read.parquet(paths.dead_letters).count() == 2
    runs = stores.last_runs(spark.read.parquet(paths.runs), 5).collect()
    assert [(r.status, r.items_ingested, r.items_failed) for r in runs] == [("SUCCESS", 1, 0), ("PARTIAL", 2, 2)]
    assert ingest.resume_state(spark, paths).first().watermark == 50


def test_breaker_stops_the_run(spark, tmp_path):
    landing, paths = str(tmp_path / "in"), ingest.IngestPaths(str(tmp_path / "out"))
    land(spark, landing, [doc(i) for i in range(94)] + ["{}"] * 6)
    with pytest.raises(StreamingQueryException):
        ingest.ingest(spark, landing, paths, NOW, "s")
    run = spark.read.parquet(paths.runs).first()
    assert (run.status, run.items_failed) == (stores.CIRCUIT_BREAKER, 6)
    assert not (tmp_path / "out" / "requests").exists() and (tmp_path / "out" / "raw").exists()


def test_conversion_counts_failures(spark):
    docs = [doc(1), "no json", '{"situacao": "A"}', '{"numeroCMCE": 4, "situacao": "A", "evolucoes": null}']
    raw = spark.createDataFrame([(d, "l") for d in docs], "conteudo_json string, origem_lista string")
    rows, failed = cons.convert_raw(raw, NOW, "s")
    assert (rows.count(), failed.count()) == (1, 3)


def test_streamed_ownership_handles_late_events(spark, tmp_path):
    base = str(tmp_path / "own")
    def batch(*rows):
        return spark.createDataFrame(rows, "request int, t string, seq int, state string, actor string").withColumn(
            "ts", C("t").cast("timestamp")).drop("t")
    ownership.update(batch((1, "2024-01-05", 2, "REALIZADA", "a"), (2, "2024-01-01", 1, "AGENDADA", "b")), 0, base, NOW)
    late = batch((1, "2024-01-01", 1, "AGUARDA_REGULACAO", "a"))
    ownership.update(late, 1, base, NOW)
    got = {r.request: (r.SLA_Tempo_Regulador_Dias, r.SLA_Tipo_Desfecho) for r in ownership.current(spark, base, late.schema).collect()}
    assert got == {1: (4.0, "POSITIVO"), 2: (0.0, "")}


def test_newest_stamp_wins_within_and_across_batches(spark, tmp_path):
    landing, paths = str(tmp_path / "in"), ingest.IngestPaths(str(tmp_path / "out"))
    land(spark, landing, [doc(1, "new", dataAlterouUltimaSituacao=9), doc(1, "old", dataAlterouUltimaSituacao=5),
                          doc(2, "first"), doc(2, "last")])
    ingest.ingest(spark, landing, paths, NOW, "s")
    assert {r.numeroCMCE: r.situacao for r in ingest.current_requests(spark, paths).collect()} == {"1": "new", "2": "last"}
    land(spark, landing, [doc(1, "late and old", dataAlterouUltimaSituacao=7), doc(3, "seen", dataAlterouUltimaSituacao=9),
                          doc(4, "fresh", dataAlterouUltimaSituacao=10), doc(5, "no stamp")])
    ingest.ingest(spark, landing, paths, NOW, "s")
    rows = {r.numeroCMCE: r.situacao for r in ingest.current_requests(spark, paths).collect()}
    assert rows == {"1": "new", "2": "last", "4": "fresh", "5": "no stamp"}
    state = ingest.resume_state(spark, paths).first()
    assert (state.watermark, state.full_sync_completed) == (10, True)


def test_breaker_counts_over_small_batches(spark, tmp_path):
    landing, paths = str(tmp_path / "in"), ingest.IngestPaths(str(tmp_path / "out"))
    for part in range(4):
        land(spark, landing, ["{}"] * 60)
    with pytest.raises(StreamingQueryException):
        ingest.ingest(spark, landing, paths, NOW, "s", max_files=1)
    run = stores.read_runs(spark, paths.runs).collect()
    assert [(r.status, r.items_failed) for r in run] == [(stores.CIRCUIT_BREAKER, 120)]


def test_one_row_per_run_and_empty_stores(spark, tmp_path):
    landing, paths = str(tmp_path / "in"), ingest.IngestPaths(str(tmp_path / "out"))
    assert ingest.current_requests(spark, paths).count() == 0 and ingest.resume_state(spark, paths).count() == 0
    land(spark, landing, ["{}"])
    ingest.ingest(spark, landing, paths, NOW, "s")
    assert ingest.current_requests(spark, paths).count() == 0 and ingest.dead_letters(spark, paths).count() == 1
    land(spark, landing, [doc(1)])
    with pytest.raises(StreamingQueryException):
        ingest.ingest(spark, landing, paths, "no day", "s")
    assert ingest.resume_state(spark, paths).count() == 0
    ingest.ingest(spark, landing, paths, NOW, "s")
    runs = stores.last_runs(stores.read_runs(spark, paths.runs)).collect()
    assert [(r.status, bool(r.error_message)) for r in reversed(runs)] == [("PARTIAL", False), ("FAILURE", True), ("SUCCESS", False)]
    assert ingest.current_requests(spark, paths).count() == 1


def test_null_history_is_a_dead_letter_in_both_forms(spark, tmp_path):
    landing, paths = str(tmp_path / "in"), ingest.IngestPaths(str(tmp_path / "out"))
    bad = doc(4).replace('"evolucoes": []', '"evolucoes": null')
    nested = doc(5, usuarioSUS={"nomeCompleto": "x", "evolucoes": None})
    land(spark, landing, [bad, nested])
    ingest.ingest(spark, landing, paths, NOW, "s")
    assert [r.errors for r in ingest.dead_letters(spark, paths).collect()] == [["evolucoes: null"]]
    assert [r.numeroCMCE for r in ingest.current_requests(spark, paths).collect()] == ["5"]


def test_keys_across_files_of_equal_names(spark, tmp_path):
    dates = ",".join(f'"{c}"' for c in DATE_COLUMNS)
    blank = ",".join('"01/02/2020"' for _ in DATE_COLUMNS)
    for folder, state in (("a", "first"), ("b", "last")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "x.csv").write_text(f'"numeroCMCE",{dates},"situacao"\n"1",{blank},"{state}"\n')
    rows, _ = files.load_csv(spark, f"{tmp_path}/*/*.csv")
    assert [r.situacao for r in cons.clean(rows).collect()] == ["last"]


def test_shared_folder_is_required_on_a_cluster(monkeypatch):
    from types import SimpleNamespace

    from queuelens.session import scratch_dir
    def fake(master):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: default),
                               sparkContext=SimpleNamespace(master=master))
    assert scratch_dir(fake("local[4]"), "x")
    for master in ("yarn", "spark://h:7077", "local-cluster[3,2,1000]"):
        with pytest.raises(RuntimeError):
            scratch_dir(fake(master), "x")
