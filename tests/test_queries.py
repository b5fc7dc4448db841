"""Every registered query beside its SQL on the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return v


@pytest.mark.parametrize("name", [n for n in sorted(entry.queries()) if not n.startswith("op") and n != "pipeline"])
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    q = duck.execute(sql)
    names = [d[0] for d in q.description]
    assert sorted(names) == columns
    assert got == sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in q.fetchall()), key=str)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
