"""Every registered query runs; those with SQL equal it row by row in DuckDB."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables here")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(n for n in entry.queries() if not n.startswith("op") and n != "pipeline"))
def test_query(spark, db, name):
    df = entry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    if name in entry.oracle_sql():
        out = db.sql(entry.oracle_sql()[name])
        assert sorted(out.columns) == columns
        at = [out.columns.index(c) for c in columns]
        assert got == sorted((tuple(plain(r[i]) for i in at) for r in out.fetchall()), key=str)


def test_entry(spark):
    assert entry.entry(spark).count() == 200
