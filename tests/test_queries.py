"""Every registered query on the smallest tables, against its SQL in DuckDB where there is one."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from tools.check import TABLES, rows_of

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = entry_module.queries(), entry_module.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLES])
def test_matches_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    cur = con.execute(ORACLES[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(cols, cur.fetchall())


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLES])
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).limit(1).count() == 1


def test_flags_of_unchecked_queries(spark):
    assert QUERIES["m4_iforest"](spark, SF).head()["planted_rank_top"]
    assert QUERIES["m1_forest"](spark, SF).head()["above_floor"]
    problems = {r["name"]: r["problem"] for r in QUERIES["s9_manifest_verify"](spark, SF).collect()}
    assert problems == {"nation.parquet": "unlisted", "customer.parquet": "missing", "orders.parquet": "mismatched"}


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
