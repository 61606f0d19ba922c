"""Driver contract: entry runs; every query agrees with its DuckDB oracle at sf0.001."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from kappaflow.sources.tables import TABLES

QUERIES = E.queries()
ORACLES = E.oracle_sql()


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "overall_max_priority" in df.columns


def test_oracle_keys_are_queries():
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) >= 60


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return str(int(v)) if v.is_integer() else f"{round(v, 6):.6f}"
    return str(v)


def _rows(cols, recs):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted(tuple(_norm(r[i]) for i in order) for r in recs)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF_SMALL)
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    if name not in ORACLES:
        pytest.skip("no SQL oracle")
    cur = duck.execute(ORACLES[name])
    want = _rows([d[0] for d in cur.description], cur.fetchall())
    assert got[0] == want[0]
    assert got[1] == want[1]
