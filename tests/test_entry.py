"""Every registered query that SQL can express agrees with DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from wordloom.plans.catalog import QUERIES
from wordloom.plans.oracles import SQL

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return con


def shown(v):
    return None if v is None else repr(round(v, 5) + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted([shown(r[c]) for c in columns].__repr__() for r in df.collect())
    assert got
    if name in SQL:
        rel = duck.execute(SQL[name])
        at = [d[0] for d in rel.description]
        assert sorted(at) == columns
        assert got == sorted([shown(r[at.index(c)]) for c in columns].__repr__() for r in rel.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
