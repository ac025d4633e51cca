import duckdb
import pytest
from pyspark.sql import functions as F

from queuelens.llm import mixing

from .conftest import wide


def test_matches_sql_and_targets(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = mixing.replicated(docs).select("row.doc_id", "row.source", "copy", "shuffle_key",
                                         F.md5(F.col("row.text").cast("binary")).alias("m")).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    assert sorted(map(tuple, got)) == sorted(con.execute(mixing.SQL).fetchall())


def test_weights_reach_their_shares(spark):
    rows = [(k, "x" * 9, "hot" if k % 3 else f"s{k % 4}") for k in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    made = mixing.replicated(docs, weights={"hot": 1.0, "s0": 2.0, "s1": 0.0}, other=1.0)
    n = {r.source: r["count"] for r in made.groupBy("row.source").count().collect()}
    assert "s1" not in n and n["s0"] == pytest.approx(2 * 6000 / 5, rel=0.1) and n["hot"] == pytest.approx(6000 / 5, rel=0.1)


def test_large_rates_are_poisson(spark):
    rows = [(k, "x", "a" if k < 300 else "b") for k in range(30_300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    counts = mixing.replicated(docs).filter("row.source = 'a'").groupBy("row.doc_id").count()
    mean, variance = counts.agg(F.avg("count"), F.var_samp("count")).first()
    assert mean == pytest.approx(50.5, rel=0.03) and variance == pytest.approx(50.5, rel=0.25)


def test_edge_cases(edge_docs, no_docs):
    extra = wide(edge_docs, "row", "copy", "times", "cdf", "shuffle_key")
    made = mixing.replicated(extra, budget=4000.0 * 60)
    assert made.select("row.*").columns == extra.columns
    repeats = {r[0]: r[1] for r in made.filter("row.doc_id = 8").groupBy("copy").count().collect()}
    assert set(repeats.values()) <= {3}
    assert mixing.replicated(no_docs).count() == 0
    with pytest.raises(ValueError):
        mixing.replicated(edge_docs, other=-1.0)
