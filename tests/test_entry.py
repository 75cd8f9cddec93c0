"""Every query of the time-series operators against its SQL, and what the driver asks of the entry file."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from pointmill.plans.catalogue import CATALOGUE

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql(f"create view events as select * from '{SF}/events.parquet'")
    return c


@pytest.mark.parametrize("name", list(CATALOGUE))
def test_query_matches_sql(spark, con, name):
    query, sql = CATALOGUE[name]
    df = query(spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in columns) for r in df.collect()), key=str)
    want = con.sql(sql)
    assert sorted(want.columns) == columns
    assert got == sorted((tuple(norm(dict(zip(want.columns, r))[c]) for c in columns) for r in want.fetchall()), key=str)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
