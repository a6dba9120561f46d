"""Every registered query with SQL equals DuckDB on the smallest tables; the others run."""

import datetime
import decimal
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tidewire.plans import core_queries, core_sql


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def compare(spark, sf, name, query, sql):
    got = query(spark, sf)
    columns = sorted(got.columns)
    rows = sorted(repr(tuple(map(plain, r))) for r in got.select(*columns).collect())
    if sql is None:
        return
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in os.listdir(sf):
        con.execute(f"create view {f[:-8]} as select * from '{sf}/{f}'")
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert rows == sorted(repr(tuple(plain(r[i]) for i in at)) for r in cur.fetchall()), name


@pytest.mark.parametrize("name", sorted(core_queries()))
def test_core_query(spark, sf, name):
    compare(spark, sf, name, core_queries()[name], core_sql().get(name))


def test_entry(spark, sf):
    rows = entry.entry(spark).collect()
    assert len(rows) == 24
    assert set(entry.oracle_sql()) <= set(entry.queries())
