"""The corpus queries that have SQL return the same rows from DuckDB, over the whole tables."""

from __future__ import annotations

import os

import duckdb
import pytest
from test_oracle import plain

from spanloom.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        p = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    got, want = queries.QUERIES[name](spark, sf).toPandas(), con.execute(queries.ORACLE_SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    assert plain(got) == plain(want)
