"""What the queries move and keep on disk or in one task."""

import glob
import os

from helpers import doc, land
from pyspark.sql import functions as F

from queuelens.operators import contract, profile, spread
from queuelens.plans import heatmap, kpi, reports
from queuelens.sources import stores
from queuelens.streaming import ingest
from queuelens.workload import streams

C = F.col


def test_landing_files_are_compressed(spark, tmp_path):
    path = str(tmp_path / "in")
    docs = spark.range(2000).select(C("id").alias("key"), F.lit(0).alias("order"),
                                    F.lit(doc(1)).alias("conteudo_json"), F.lit("l").alias("origem_lista"))
    streams._land(docs, path)
    assert sum(os.path.getsize(f) for f in glob.glob(f"{path}/part-*")) < 2000 * len(doc(1)) / 5
    assert spark.read.json(path).count() == 2000


def test_checked_documents_are_dealt_out_by_their_stored_key(spark, tmp_path):
    path = str(tmp_path / "in")
    land(spark, path, [doc(k) for k in range(40)] + ["no json", None])  # one file, so one task reads it
    batch = spark.read.schema(ingest.LANDING_SCHEMA).json(path).withColumn("file", F.struct(F.lit(1).alias("n")))
    staged = ingest._staged(batch, spark.createDataFrame([], ingest.MARKS_SCHEMA)).cache()
    assert staged.count() == 42
    assert staged.filter("storable").count() == 40 and staged.filter("taken").count() == 40
    plan = ingest.latest_per_key(staged.filter("taken"), "protocolo", [F.desc("place")])._jdf.queryExecution().toString()
    planned = plan[plan.index("== Physical Plan =="):]
    assert "Exchange" not in planned[:planned.index("InMemoryRelation")]  # the texts do not move again
    staged.unpersist()


def test_a_batch_of_hash_parts_fills_all_tasks(spark, tmp_path):
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = spark.range(4000).select(C("id").cast("string").alias("key"), F.to_json(F.struct(
        C("id").alias("numeroCMCE"), F.lit("A").alias("situacao"))).alias("conteudo_json"), F.lit("l").alias("origem_lista"))
    rows.repartition(parts, "key").write.json(str(tmp_path / "in"))
    one = sorted(glob.glob(f"{tmp_path}/in/part-*"))[:1]  # one file of a hash by key over as many parts as a shuffle has
    batch = spark.read.schema(ingest.LANDING_SCHEMA).json(one).withColumn("file", F.struct(F.lit(1).alias("n")))
    sizes = [r["count"] for r in ingest._staged(batch, spark.createDataFrame([], ingest.MARKS_SCHEMA)).groupBy(
        F.spark_partition_id()).count().collect()]
    assert len(sizes) > parts and max(sizes) < 2 * min(sizes) and sum(sizes) == batch.count()


def test_objects_are_taken_apart_in_one_pass(spark):
    sql = contract.errors_expression("j")
    assert sql.count("try_variant_get(v, '$', 'STRUCT<") == 1 and sql.count("'$.numeroCMCE'") == sql.count("'$.data'") == 0
    texts = {'{"numeroCMCE": "7", "dataAlterouUltimaSituacao": 9}': ("7", 9, True), '{"error": null}': (None, 0, False),
             "[1]": (None, 0, True), "null": (None, 0, False), "no": (None, 0, False)}
    df = spark.createDataFrame([(t,) for t in texts], "j string").selectExpr("j", f"{stores.head_of('j')} AS h")
    assert {r.j: tuple(r.h) for r in df.collect()} == texts


def _rows(spark, tmp_path, n):
    path = str(tmp_path / "rows")
    (spark.range(0, n, 1, 4).select((C("id") % 5000).alias("numeroCMCE"), F.concat(F.lit("M"), C("id") % 3).alias("a"),
                                    F.when(C("id") % 7 > 0, F.sha2(C("id").cast("string"), 512)).alias("b")).write.parquet(path))
    return spark.read.parquet(path)


def test_tasks_of_an_aggregation_grow_with_the_files(spark, tmp_path, monkeypatch):
    rows = _rows(spark, tmp_path, 20_000)
    held = spread.size_of(spark, rows.inputFiles())
    assert held == sum(os.path.getsize(f) for f in glob.glob(f"{tmp_path}/rows/*.parquet"))
    monkeypatch.setattr(spread, "TASK_BYTES", held // 37)
    assert spread.spread(rows.filter("a = 'M1'"), "numeroCMCE").rdd.getNumPartitions() == 38  # small ones are not joined
    pairs = reports.actor_diagnosis(rows, "a", "b", at_least=1)
    assert "hashpartitioning(ator" in pairs._jdf.queryExecution().toString() and ", 38)" in pairs._jdf.queryExecution().toString()


def test_counts_by_shares(spark, tmp_path):
    rows = _rows(spark, tmp_path, 20_000).union(spark.createDataFrame([(None, "M9", "x")] * 2, "numeroCMCE bigint, a string, b string"))
    for groups in (["a"], ["a", "b"]):
        wanted = rows.groupBy(*groups).agg(F.countDistinct("numeroCMCE").alias("Vol")).collect()
        assert sorted(map(str, spread.distinct_per_group(rows, "numeroCMCE", *groups).collect())) == sorted(map(str, wanted))


def test_quantile_rows_stay_where_they_are(spark):
    pairs = profile.numeric_pairs(spark.range(3000).select("id", (C("id") % 7).alias("m")))
    plan = profile.exact_quantiles(pairs, "column", "value", [0.25, 0.5])._jdf.queryExecution().toString()
    assert "percentile_approx" not in plan and "unpivot" not in plan.lower()  # both the brackets and the cells are stored


def test_checks_take_no_text_of_blocks_and_histories(spark):
    sql = contract.errors_expression("j")
    assert sql.count("try_variant_get(p.evolucoes, '$', 'string')") == sql.count("try_variant_get(p.usuarioSUS, '$', 'string')") == 0
    good = '"numeroCMCE": 1, "situacao": "A"'
    cases = {
        f'{{{good}}}': "", f'{{{good}, "evolucoes": []}}': "", f'{{{good}, "evolucoes": null}}': "evolucoes: null",
        f'{{{good}, "evolucoes": {{"data": 1}}}}': "evolucoes: wrong type", f'{{{good}, "evolucoes": "x"}}': "evolucoes: wrong type",
        f'{{{good}, "evolucoes": [{{"data": "3"}}, {{"data": true, "detalhes": "d"}}]}}': "",
        f'{{{good}, "evolucoes": [1, null, {{"data": "x"}}]}}': "evolucoes: wrong type; evolucoes.data: wrong type",
        f'{{{good}, "usuarioSUS": []}}': "usuarioSUS: wrong type", f'{{{good}, "usuarioSUS": {{}}}}': "usuarioSUS.nomeCompleto: missing",
        '{"numeroCMCE": "1.0", "situacao": 5}': "situacao: wrong type", f'{{{good}, "error": null}}': "payload: corrupt"}
    df = spark.createDataFrame([(j,) for j in cases], "j string").selectExpr("j", f"array_join({sql}, '; ') AS e")
    assert {r.j: r.e for r in df.collect()} == cases


def test_streamed_ownership_takes_three_batches(spark, tmp_path, monkeypatch):
    rows = [(k, f"2024-01-{1 + k % 28:02d} 00:00:00", k % 5, "click", 1.0, '{"k": 1}') for k in range(200)]
    (spark.createDataFrame(rows, "event_id bigint, ts string, user_id bigint, event_type string, value double, props string")
     .withColumn("ts", C("ts").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/events.parquet"))
    seen, real = set(), streams.ownership.update
    monkeypatch.setattr(streams.ownership, "update", lambda batch, n, *a: seen.add(n) or real(batch, n, *a))
    assert streams.stream_ownership(spark, str(tmp_path)).count() == 5
    assert seen == {0, 1, 2}


def test_heat_map_and_headline_rows_are_spread(spark, monkeypatch):
    seen = []
    for module in (heatmap, kpi):
        monkeypatch.setattr(module, "spread", lambda rows, *keys: seen.append(keys) or spread.spread(rows, *keys), raising=False)
    rows = spark.createDataFrame([("1", "a", "d")], "numeroCMCE string, a string, b string")
    assert heatmap.cells(rows, "a", "b", 5, 5).count() == 1
    wide = rows.select("numeroCMCE", *[F.lit("x").alias(c) for c in kpi.DIMENSIONS.values()], F.lit("").alias("entidade_classificacaoRisco_cor"),
                       *[F.lit("2024-01-01").cast("timestamp").alias(c) for c in ("dataSolicitacao", "dataCadastro")])
    assert kpi.kpi_base(wide, None, "2024-02-01").first().pacientes == 1
    assert seen == [("numeroCMCE", "a", "b"), ("numeroCMCE", *kpi.DIMENSIONS.values())]
