"""Registered queries against their SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from floodlens.plans.oracle import ORACLES
from floodlens.plans.queries import QUERIES

@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for path in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def test_every_query_is_checked():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["src_ip", "window_start", "is_attack", "state", "blocked_until"]
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, data, name):
    df = QUERIES[name](spark, data)
    rel = duck.execute(ORACLES[name])
    columns = [d[0] for d in rel.description]
    assert sorted(df.columns) == sorted(columns)
    want = rel.fetchall()
    got = [tuple(r[c] for c in columns) for r in df.collect()]

    def key(row):
        return [(v is None, str(v)) for v in row]

    assert sorted(got, key=key) == sorted(want, key=key)
    assert got
