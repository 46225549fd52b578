"""Every registered query runs on the smallest tables; those with SQL give what DuckDB gives."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    return value if value is None or isinstance(value, (bool, int)) else str(value)


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def test_sql_has_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() == 400


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_gives_what_sql_gives(spark, tables, name):
    found = entry.queries()[name](spark, FOLDER)
    columns = sorted(found.columns)
    got = [tuple(plain(v) for v in r) for r in found.select(*columns).collect()]
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert columns
        return
    result = tables.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = [tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
