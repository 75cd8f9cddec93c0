"""The registered queries that have SQL, against DuckDB."""

import os

import duckdb
import pytest

from pointmill.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def norm(v):
    return float(f"{v:.9g}") + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df, want = queries.queries()[name](spark, SF), con.sql(queries.oracle_sql()[name])
    columns = sorted(df.columns)
    assert sorted(want.columns) == columns
    got = sorted((tuple(norm(r[c]) for c in columns) for r in df.collect()), key=str)
    assert got == sorted((tuple(norm(dict(zip(want.columns, r))[c]) for c in columns) for r in want.fetchall()), key=str)
