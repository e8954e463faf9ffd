"""The driver's contract, and every query with SQL against DuckDB on the smallest tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

import __spark_entry__ as E

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def canon(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    if isinstance(v, list | tuple):
        return tuple(canon(x) for x in v)
    return str(v) if hasattr(v, "isoformat") else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def test_entry_runs(spark) -> None:
    assert E.entry(spark).count() > 0


def test_sql_belongs_to_queries() -> None:
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_equals_sql(spark, duck, name: str) -> None:
    df = E.queries()[name](spark, DATA)
    cur = duck.execute(E.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    want = sorted((tuple(canon(r[names.index(c)]) for c in order) for r in cur.fetchall()), key=str)
    got = sorted((tuple(canon(r[c]) for c in order) for r in df.collect()), key=str)
    assert got == want
