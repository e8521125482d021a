"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from wakeline.plans.catalogue import ORACLE_SQL, QUERIES

DATA, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{DATA}/{name}.parquet'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, bool | str):
        return value
    return round(float(value), 6)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, sql, name):
    got = QUERIES[name](spark, DATA)
    want = sql.sql(ORACLE_SQL[name])
    assert table(got.columns, got.collect()) == table(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs_without_sql(spark, name):
    """They find something, and the same again."""
    first = QUERIES[name](spark, LARGER)
    rows = sorted(map(tuple, first.collect()), key=repr)
    assert len(first.columns) >= 2 and rows
    assert rows == sorted(map(tuple, QUERIES[name](spark, LARGER).collect()), key=repr)


def test_entry_gives_rows(spark):
    assert entry_module.entry(spark).count() > 0


def test_registry_is_complete():
    assert set(QUERIES) <= set(entry_module.queries())
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
