"""A quick part of the registered queries against DuckDB; tools/oracle_check.py runs all."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry  # noqa: E402
from oracle_check import rows_of  # noqa: E402
from queuelens.workload.views import TABLES  # noqa: E402

QUICK = ["kpi_summary", "kpi_empty", "boxplot_stats", "place_top30", "heatmap_z_col", "text_entity", "custom_sql",
         "lenient_cast", "ownership_days", "running_breaker", "incremental_cut", "profile_columns"]


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def test_every_oracle_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship_query(spark):
    assert entry.entry(spark).count() == 1


@pytest.mark.parametrize("name", QUICK)
def test_query_matches_sql(spark, sf_dir, duck, name):
    df = entry.queries()[name](spark, sf_dir)
    cursor = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, cursor.fetchall())
