"""Each query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables aren't here")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{name}')")
    return con


def test_entry(spark):
    assert entry.entry(spark).count() == 200


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, tables, name):
    rows = entry.queries()[name](spark, SF)
    columns = sorted(rows.columns)
    got = sorted(repr(tuple(r[c] for c in columns)) for r in rows.collect())
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    found = tables.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert got == sorted(repr(tuple(r[names.index(c)] for c in columns)) for r in found.fetchall())
