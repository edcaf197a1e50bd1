"""Every registered query of the library against its SQL twin on the smallest tables."""

import datetime
import math

import duckdb
import pytest

from kgspark import queries as registered
from kgspark.adapters import TABLES

SF = "/root/testdata/sf0.001"
QUERIES, SQL = registered.queries(), registered.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return v


def table(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    rows = [tuple(r) for r in got.collect()]
    if name not in SQL:
        assert rows
        return
    want = duck.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert table(got.columns, rows) == table(want.columns, want.fetchall())


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(SQL)
