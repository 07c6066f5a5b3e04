"""Queries with SQL against DuckDB on whole small tables."""

import os

import duckdb
import pytest

from skein.llm.registry import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    data = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for f in os.listdir(data):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{data}/{f}'")
    got, want = QUERIES[name](spark, data), con.sql(ORACLES[name])
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    at = [list(want.columns).index(c) for c in names]
    assert sorted(str([r[c] for c in names]) for r in got.collect()) == sorted(str([r[i] for i in at]) for r in want.fetchall())
