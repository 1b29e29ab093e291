"""Every query with SQL gives the same rows as DuckDB on the same tables."""

import math
import os

import duckdb
import pytest

from quillforge.plans import queries as core

SQL = core.oracle_sql()


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for f in os.listdir(data):
        c.execute(f"create view {f.split('.')[0]} as select * from '{data}/{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return v


@pytest.mark.parametrize("name", sorted(core.queries()))
def test_query(spark, data, duck, name):
    df = core.queries()[name](spark, data)
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert len(set(df.columns)) == len(df.columns)
    if name not in SQL:
        assert rows
        return
    got = duck.execute(SQL[name])
    names = [x[0] for x in got.description]
    assert sorted(names) == columns
    assert sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in got.fetchall()), key=repr) == rows


def test_entry_contract(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
