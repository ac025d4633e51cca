import pytest
from pyspark.sql import functions as F

from queuelens.operators import access, predicates as p
from queuelens.rules import DEFAULT_RULES

C = F.col


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(
        [(1, "VERMELHO", "2024-01-02", True, "x"), (2, "VERDE", "2024-01-01", False, ""),
         (3, None, "2023-12-31", None, None), (4, "vermelho", "2024-01-18", True, "y")],
        "k int, cor string, dia string, flag boolean, txt string")


def keys(df):
    return sorted(r.k for r in df.collect())


@pytest.mark.parametrize("limit, expected", [(30, [2, 3]), (29, [1, 2, 3]), (31, [3]), (14, [1, 2, 3]), (13, [1, 2, 3, 4])])
def test_wait_limits_are_strict(rows, limit, expected):
    # waits on 2024-02-01: 30, 31, 32 and 14 days
    assert keys(rows.filter(p.waiting_longer(C("dia"), "2024-02-01", limit))) == expected


def test_urgent_is_case_sensitive_unless_asked(rows):
    assert keys(rows.filter(p.urgent(C("cor"), DEFAULT_RULES.urgent_colours))) == [1]
    assert keys(rows.filter(p.urgent(C("cor"), DEFAULT_RULES.urgent_colours, ignore_case=True))) == [1, 4]


@pytest.mark.parametrize("a", [True, False])
@pytest.mark.parametrize("b", [True, False])
def test_truth_tables(spark, a, b):
    row = spark.range(1).select(p.all_of([F.lit(a), F.lit(b)]), p.any_of([F.lit(a), F.lit(b)]), ~F.lit(a)).first()
    assert tuple(row) == (a and b, a or b, not a)


def test_sets_flags_and_presence(rows):
    assert keys(rows.filter(p.exclude(C("cor"), ["VERDE"]))) == [1, 4]
    assert keys(rows.filter(p.is_no(C("flag")))) == [2, 3]
    assert keys(rows.filter(p.present(C("txt")))) == [1, 4]
    assert keys(rows.filter(p.absent(C("txt")))) == [2, 3]
    assert keys(rows.filter(p.all_of([None, p.include(C("cor"), [])]))) == [1, 2, 3, 4]


def test_date_range(rows):
    assert keys(rows.filter(p.date_range(C("dia"), "2024-01-01", "2024-01-02"))) == [1, 2]
    assert keys(rows.filter(p.date_range(C("dia"), as_of="2024-01-31"))) == [1, 2, 4]
    assert p.date_range(C("dia")) is None


def test_outcome_in_progress(spark):
    df = spark.createDataFrame([(1, ""), (2, None), (3, "POSITIVO"), (4, "NEGATIVO")], "k int, o string")
    assert keys(df.filter(p.outcome_include(C("o"), [p.IN_PROGRESS, "POSITIVO"]))) == [1, 2, 3]
    assert keys(df.filter(p.outcome_exclude(C("o"), [p.IN_PROGRESS]))) == [3, 4]


def test_text_search_is_literal_and_accent_blind(spark):
    df = spark.createDataFrame([(1, "Avaliação 'cardio'"), (2, "a\\b"), (3, None)], "k int, t string")
    assert keys(df.filter(p.text_any(C("t"), "AVALIACAO, zzz"))) == [1]
    assert keys(df.filter(p.text_any(C("t"), "a\\b"))) == [2]
    assert keys(df.filter(p.text_any(C("t"), "'cardio'"))) == [1]
    assert keys(df.filter(p.text_none(C("t"), "cardio"))) == [2]


def test_entity_search_drops_all_null_entities(spark):
    df = spark.createDataFrame([("a", "dor"), ("a", None), ("b", None), ("c", "febre")], "e string, t string")
    assert p.entity_text(df, "e", "t", any_terms="dor").count() == 2
    assert [r.e for r in p.entity_text(df, "e", "t", no_terms="dor").collect()] == ["c"]


def test_row_security(rows):
    assert access.secured(rows, None).count() == 0
    assert access.secured(rows, "someone").count() == 4


def test_custom_sql_sees_only_the_secured_frame(spark, rows):
    sql = "SELECT count(*) AS n FROM {requests}"
    assert access.custom_sql(spark, sql, rows, "u", C("k") > 2).first().n == 2
    assert access.custom_sql(spark, sql, rows, None).first().n == 0
    rows.createOrReplaceTempView("base_rows")
    try:
        with pytest.raises(ValueError):
            access.custom_sql(spark, "SELECT * FROM base_rows", rows, "u")
    finally:
        spark.catalog.dropTempView("base_rows")
    with pytest.raises(Exception):
        access.custom_sql(spark, "SELECT * FROM parquet.`/root/testdata/sf0.001/part.parquet`", rows, "u")


@pytest.mark.parametrize("sql", [
    "SELECT count(*) FROM global_temp.secret_rows", "SELECT * FROM other_db.t", "SELECT * FROM secret_rows",
    "SELECT (SELECT max(k) FROM secret_rows) AS m FROM {requests}",
    "SELECT * FROM {requests} WHERE k IN (SELECT k FROM secret_rows)",
    "SELECT * FROM (WITH secret_rows AS (SELECT 1 AS k) SELECT * FROM secret_rows) a JOIN secret_rows b ON a.k = b.k",
    "WITH a AS (SELECT * FROM b), b AS (SELECT 1 AS k) SELECT * FROM a",
    "INSERT OVERWRITE DIRECTORY '/tmp/never' USING parquet SELECT * FROM {requests}", "SET spark.sql.shuffle.partitions = 3",
    "CREATE TABLE never AS SELECT * FROM {requests}", "DROP VIEW secret_rows", "SHOW TABLES", "DESCRIBE secret_rows",
    "EXPLAIN SELECT 1", "CACHE TABLE secret_rows", "SELECT * FROM range(3)", "SELECT * FROM csv.`/etc/passwd`",
    "SELECT reflect('java.lang.System', 'getenv', 'HOME') FROM {requests}", "SELECT java_method('java.lang.System', 'nanoTime')"])
def test_custom_sql_refuses_everything_else(spark, rows, sql):
    rows.createOrReplaceTempView("secret_rows")
    rows.createOrReplaceGlobalTempView("secret_rows")
    try:
        with pytest.raises(ValueError):
            access.custom_sql(spark, sql, rows, None)
    finally:
        spark.catalog.dropTempView("secret_rows")
        spark.catalog.dropGlobalTempView("secret_rows")


def test_custom_sql_allows_plain_queries(spark, rows):
    rows.createOrReplaceTempView("k")  # a view named like a column is no obstacle
    sql = """WITH a AS (SELECT k, row_number() OVER (ORDER BY k) AS n FROM {requests}), b AS (SELECT * FROM a WHERE n > 1)
        SELECT x.k, count(*) AS c FROM b x JOIN {requests} y ON x.k >= y.k GROUP BY x.k HAVING count(*) > 1
        UNION ALL SELECT * FROM VALUES (-1, 0) ORDER BY 1 LIMIT 3"""
    try:
        assert access.custom_sql(spark, sql, rows, "u").count() > 0
    finally:
        spark.catalog.dropTempView("k")
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("requests_")]


def test_user_values_are_quoted_in_patterns(spark):
    texts = spark.createDataFrame([("exame a.b",), ("exame axb",), ("exame [x",), ("EXAME A.B (3)",)], "t string")
    found = lambda *v: {r.t for r in texts.filter(p.pending_match(C("t"), v)).collect()}
    assert found("exame a.b") == {"exame a.b", "EXAME A.B (3)"} and found("exame [x") == {"exame [x"}
    assert found("a|b", "\\E", "(3)") == {"EXAME A.B (3)"}


def test_options_of_any_type_and_of_expressions(spark):
    df = spark.createDataFrame([(2, "b 1"), (None, ""), (1, None), (2, "a 1")], "n int, t string")
    assert [r.n for r in access.options(df, "n").collect()] == [1, 2]
    assert [r.word for r in access.options(df, F.split("t", " ")[0], C("n") > 0, "word").collect()] == ["a", "b"]
    lists = access.cascading_options(df, {"t": C("n") == 2, "n": None}).collect()
    assert [(r.column, r.value) for r in lists] == [("t", "a 1"), ("t", "b 1"), ("n", "2")]
