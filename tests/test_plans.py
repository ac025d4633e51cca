import collections
import random

import numpy as np
import pyarrow.parquet as pq
import pytest
from helpers import stage_totals
from pyspark.sql import functions as F

from queuelens.operators import contract, dedup, profile
from queuelens.plans import distribution, heatmap, legacy, reports
from queuelens.sources import layout
from queuelens.workload import registry

C = F.col


def test_exact_quantiles_on_skewed_data(spark):
    rng = random.Random(5)
    data = {"hot": [7.0] * 4000 + [rng.gauss(0, 1e6) for _ in range(2000)],
            "flat": [rng.random() for _ in range(977)], "tiny": [1.0, 2.0, 10.0], "one": [3.5]}
    df = spark.createDataFrame([(g, v) for g, vs in data.items() for v in vs] + [("one", None)], "g string, v double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    # a coarse sketch makes wide gaps and brackets, the figures must stay exact
    for accuracy in (50, 10000):
        for r in profile.exact_quantiles(df, "g", "v", probs, accuracy).collect():
            assert [r[f"q{i}"] for i in range(len(probs))] == pytest.approx(list(np.quantile(data[r.g], probs)))


def test_boxplot_trims_then_measures(spark):
    days = [1, 2, 3, 4, 5, 6, 7, 8, 9, 1000]
    w = spark.createDataFrame([(i, d, 0) for i, d in enumerate(days)], "numeroCMCE int, dias_fila int, dias_esquecido int")
    row = distribution.boxplot(w).filter("measure = 'dias_fila'").first()
    clean = days[:-1]
    assert (row.low_fence, row.median, row.high_fence) == (1, 5.0, 9)
    assert (row.q1, row.q3) == (np.quantile(clean, .25), np.quantile(clean, .75))


def test_heatmap_single_member_and_zero_spread(spark):
    cells = spark.createDataFrame([("a", "d1", 2), ("b", "d1", 2)], "ator string, diag string, Vol long")
    rows = heatmap.z_scores(heatmap.matrix(cells), "diag").collect()
    assert {r.z for r in rows} == {0.0} and {r.z_text for r in rows} == {"+0.0"}
    alone = heatmap.z_scores(heatmap.matrix(cells), "ator").collect()
    assert {r.z for r in alone} == {None}


def test_hierarchy_weights_parents(spark):
    leaves = spark.createDataFrame([("A", "x", 1, 10.0), ("A", "y", 3, 2.0)], "p string, c string, Vol long, Metrica_Cor double")
    top = reports.hierarchy(leaves, ["p", "c"]).filter("depth = 1").first()
    assert (top.Vol, top.Metrica_Cor) == (4, 4.0)


def test_history_exploder(spark):
    text = "[01/02/2020 | Anamnese | UBS]: linha 1\nlinha 2 | \n\n[02/02/2020 10:11:12 | Parecer | Central]: ok"
    df = spark.createDataFrame([(1, text), (2, None), (3, "livre")], f"k int, `{legacy.HISTORY_COLUMN}` string")
    rows = legacy.explode_history(df).orderBy("k", "Data_Evolucao").collect()
    assert [(r.k, r.Tipo_Informacao, r.Texto_Evolucao) for r in rows] == [
        (1, "Anamnese", "linha 1\nlinha 2"), (1, "Parecer", "ok"), (2, None, None), (3, None, None)]
    assert str(rows[1].Data_Evolucao) == "2020-02-02 10:11:12"
    other = spark.range(1)
    assert legacy.explode_history(other) is other


def test_keep_last_null_keys_form_one_group(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 3), (None, 4), (" ", 5)], "k string, pos int")
    assert sorted(r.pos for r in dedup.keep_last(df, "k", ["pos"]).collect()) == [2, 4]


def test_table_contract(spark):
    with pytest.raises(contract.ContractError):
        contract.require_columns(spark.range(1))
    assert contract.legacy_columns(spark.range(1).withColumnRenamed("id", "Protocolo")) == ["Protocolo"]


def test_profile_rules(spark):
    df = spark.createDataFrame([(i, f"{i}/01/2020", "x", None, float(i)) for i in range(1, 21)],
                               "ident int, quando string, fixo string, vazio string, valor double")
    rows = {r.coluna: r for r in profile.profile(df, ["ident"], "2024-01-01").collect()}
    assert rows["ident"].tipo_inferido == "identificador_potencial"
    assert rows["quando"].tipo_inferido == "data_hora_texto"
    assert rows["fixo"].observacoes == "coluna constante; categoria dominante >95%"
    assert rows["vazio"].observacoes == "100% nula; muitos nulos (>90%)" and rows["vazio"].cardinalidade == "sem valores"
    assert rows["valor"].tipo_inferido == "numerica_continua" and rows["valor"].num_mediana == 10.5


def plan_of(spark, sf_dir, name):
    return registry()[name][0](spark, sf_dir)._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", ["kpi_summary", "wait_deciles", "funnel_stages", "heatmap_z_row", "volume_by_dims",
                                  "ownership_days", "text_entity", "profile_numeric", "cascading_options"])
def test_no_cross_joins_and_no_python_rows(spark, sf_dir, name):
    plan = plan_of(spark, sf_dir, name)
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "Window [*] []"):
        assert bad not in plan


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    plan = plan_of(spark, sf_dir, "filter_date_range")
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate" in plan
    assert "o_totalprice" not in plan[plan.index("== Physical Plan"):]


def test_top_rows_per_group_are_cut_before_the_shuffle(spark, sf_dir):
    assert "WindowGroupLimit" in plan_of(spark, sf_dir, "sample_per_group")
    assert "WindowGroupLimit" in plan_of(spark, sf_dir, "keep_last")


def test_sizes_out_of_range_are_errors(spark):
    df = spark.createDataFrame([], "a string, numeroCMCE int")
    for k in (4, 101):
        with pytest.raises(ValueError):
            heatmap.top_members(df, "a", k)
    for n in (9, 1001):
        with pytest.raises(ValueError):
            reports.audit_list(df, None, n)


def test_shared_inputs_are_read_once(spark, sf_dir):
    def scans(name):
        plan = registry()[name][0](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        return [t for t in ("lineitem", "orders", "part", "events") for _ in range(plan.count(f"/{t}.parquet"))]
    assert scans("heatmap_z_row") == [] and scans("kpi_summary") == []  # both read what was stored once
    assert scans("first_event") == ["events"] and scans("global_bounds").count("orders") == 1


def test_ownership_has_one_exchange_of_events(spark, sf_dir):
    plan = plan_of(spark, sf_dir, "ownership_days")
    assert "rangepartitioning" not in plan
    exchanges = [line for line in plan[plan.index("== Physical Plan"):].split("\n") if "Exchange hashpartitioning" in line]
    # events once by request (and piece), then the pieces' summaries by request
    assert len(exchanges) <= 2


def test_profile_shuffles_no_texts(spark):
    df = spark.createDataFrame([(1, "a long text", "01/02/2020"), (2, None, "x")], "id int, t string, d string")
    for frame in (profile.text_stats(df), profile.date_like(df), profile.counts(df)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        keys = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line]
        assert not any("value" in k or " t#" in k for k in keys), keys
    assert {r.column: r.is_date_like for r in profile.date_like(df).collect()} == {"t": False, "d": False}


def test_a_matrix_has_a_bound(spark):
    cells = spark.range(101).selectExpr("CAST(id AS STRING) AS ator", "'d' AS diag", "1L AS Vol")
    with pytest.raises(Exception, match="too many members"):
        heatmap.matrix(cells).collect()
    assert heatmap.matrix(cells.limit(100)).count() == 100


def test_bucketed_tables_need_no_shuffle_by_the_request(spark, sf_dir, tmp_path):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("bucketed_p90", "bucketed_funnel", "bucketed_entity"):
            frame = registry()[name][0](spark, sf_dir)
            plan = frame._jdf.queryExecution().executedPlan().toString()
            assert "hashpartitioning" not in plan and plan.count("Bucketed: true") >= 1, name
        assert "Exchange" not in plan  # the last one has no total either
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_bucketed_table_opens_in_another_catalog(spark, tmp_path):
    df = spark.range(500).selectExpr("id % 50 AS numeroCMCE", "id AS v", "array(id) AS l")
    layout.write_bucketed(df, "first_name", str(tmp_path / "t"), buckets=4)
    opened = layout.open_bucketed(spark, "second_name", str(tmp_path / "t"))
    plan = opened.groupBy("numeroCMCE").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and opened.count() == 500 and opened.schema == df.schema
    assert len(list((tmp_path / "t").glob("part-*"))) == 4


def test_date_filters_skip_row_groups(spark, tmp_path):
    n = 60_000
    df = spark.range(n).select(
        C("id").alias("numeroCMCE"), F.timestamp_seconds(1_600_000_000 + F.pmod(F.xxhash64("id"), F.lit(1000)) * 86_400).alias("dataSolicitacao"),
        F.concat(F.lit("l"), C("id") % 5).alias("origem_lista"), F.md5(C("id").cast("string")).alias("text"))
    path = str(tmp_path / "t")
    layout.write_clustered(df, path, files=8, row_group_mb=0.05)
    low, high = 1_600_000_000 + 400 * 86_400, 1_600_000_000 + 429 * 86_400
    groups = met = 0
    for name in (tmp_path / "t").glob("part-*"):
        meta = pq.ParquetFile(name).metadata
        column = next(i for i in range(meta.num_columns) if meta.row_group(0).column(i).path_in_schema == "dataSolicitacao")
        for g in range(meta.num_row_groups):
            span = pq.read_table(name, columns=["dataSolicitacao"]).column(0) if meta.num_row_groups == 1 else \
                pq.ParquetFile(name).read_row_group(g, columns=["dataSolicitacao"]).column(0)
            seconds = [v.timestamp() for v in span.to_pylist()]
            groups += 1
            met += min(seconds) <= high and max(seconds) >= low
    assert groups >= 60 and met <= 0.1 * groups
    assert spark.read.parquet(path).count() == n


def test_frequent_values_shuffle_no_texts(spark):
    def cost(pad):
        df = spark.range(4000).select(F.concat(F.lit("x" * pad), (C("id") % 1500).cast("string"), F.lit("y" * pad)).alias("t"))
        out, _, shuffled = stage_totals(spark, lambda: profile.frequent_values(df, 3, head=8 if pad < 8 else 2000).collect())
        return [(r.value.strip("xy"), r.Quantidade) for r in out], shuffled
    short, long = cost(1), cost(900)
    assert sorted(short[0]) == sorted(long[0]) and long[1] < 6 * short[1]


@pytest.mark.parametrize("most", [10_000, 5])
def test_frequent_values_break_ties_by_value(spark, most):
    rng = random.Random(9)
    rows = [(f"common start of all values {rng.randint(0, 300):03d}", rng.choice(["a", "b", "c", None, ""]), k) for k in range(500)]
    df = spark.createDataFrame(rows, "u string, v string, w int")
    want = []
    for i, name in enumerate("uvw"):
        counts = collections.Counter(str(r[i]) for r in rows if r[i] is not None)
        want += [(name, v, n) for v, n in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:4]]
    assert sorted(map(tuple, profile.frequent_values(df, 4, most=most).collect())) == sorted(want)
    assert profile.frequent_values(df.limit(0), 4).count() == 0
