"""The driver's entry: every query has SQL, and both give the same rows."""

import duckdb
import pytest

import __spark_entry__ as e
from keyloom.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    held = duckdb.connect()
    for table in ("supplier", "lineitem", "events", "embeddings"):
        held.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return held


def plain(value):
    return round(value, 9) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, con, name):
    got = QUERIES[name](spark, SF)
    want = con.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    rows = sorted(repr(tuple(plain(v) for v in r)) for r in got.select(*names).collect())
    assert rows == sorted(repr(tuple(map(plain, r))) for r in want.fetchall())


def test_entry(spark):
    assert e.entry(spark).count() == 6000
    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(QUERIES) == set(ORACLES)
