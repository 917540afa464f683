"""Every query with SQL gives what DuckDB gives on the smallest tables."""

import glob
import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


def core_queries():
    import importlib

    return sorted(k for m in entry.CORE for k in importlib.import_module(m).QUERIES)


@pytest.mark.parametrize("name", core_queries())
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    got = df.collect()
    sql = entry.oracle_sql().get(name)
    if sql:
        found = duck.execute(sql)
        names = [d[0] for d in found.description]
        assert sorted(names) == sorted(df.columns)
        order = [names.index(c) for c in sorted(names)]
        assert sorted(repr(tuple(r[i] for i in order)) for r in found.fetchall()) == sorted(repr(tuple(r[c] for c in sorted(names))) for r in got)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
