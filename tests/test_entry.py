"""Registered queries against their SQL counterparts on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from scanframe import oracles
from scanframe import queries as registered

SF = "/root/testdata/sf0.001"
NAMES = sorted(oracles.ORACLES)


def test_every_query_has_sql():
    assert set(oracles.ORACLES) == set(registered.QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    df = entry.queries()[name](spark, SF)
    sql = con.sql(entry.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(sql.columns)
    place = [sql.columns.index(c) for c in columns]
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
    assert got == sorted((tuple(r[i] for i in place) for r in sql.fetchall()), key=str)
