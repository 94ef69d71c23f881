"""Every query against its SQL, over the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for path in glob.glob(f"{DIR}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    return v


def test_sql_has_queries():
    assert set(SQL) <= set(QUERIES) and len(QUERIES) > 40


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    got = sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr)
    assert df.columns and (got or name in {"p10_found"})
    if name in SQL:
        cursor = duck.execute(SQL[name])
        columns = [c[0] for c in cursor.description]
        assert sorted(columns) == sorted(df.columns)
        want = [dict(zip(columns, r)) for r in cursor.fetchall()]
        assert got == sorted((tuple(plain(r[c]) for c in sorted(columns)) for r in want), key=repr)


def test_entry(spark):
    assert entry.entry(spark).columns
