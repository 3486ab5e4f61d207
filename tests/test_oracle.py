"""Every registered query of the record engine against DuckDB on the same tables."""

import math

import duckdb
import pytest

from recordloom.plans.catalog import ORACLE, QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "~"
    if isinstance(v, bool):
        return str(v)
    return f"{float(v):.6g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, FOLDER)
    want = duck.sql(ORACLE[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    mine = sorted(tuple(plain(r[c]) for c in cols) for r in got.collect())
    at = [want.columns.index(c) for c in cols]
    assert mine == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())


def test_all_have_sql():
    assert set(QUERIES) == set(ORACLE)
