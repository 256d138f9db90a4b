"""Every registered query runs; those with SQL return the same rows from DuckDB."""

from __future__ import annotations

import os

import duckdb
import pandas as pd
import pytest

from spanloom.plans import catalog, coverage, decisions, inference, ingest, variants  # noqa: F401  all register queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def plain(d: pd.DataFrame) -> list[tuple]:
    d = d[sorted(d.columns)]

    def one(x):
        if isinstance(x, float) and x != x or x is None or x is pd.NaT:
            return None
        if isinstance(x, bool):
            return x
        if hasattr(x, "item"):
            x = x.item()
            if x != x:
                return None
        if isinstance(x, float):
            return round(x, 5) + 0.0
        return x

    return sorted((tuple(one(x) for x in r) for r in d.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, sf, name):
    got = catalog.QUERIES[name](spark, sf).toPandas()
    if name not in catalog.ORACLE_SQL:
        assert len(got.columns) > 0
        return
    want = duck.execute(catalog.ORACLE_SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = plain(got), plain(want)
    assert len(a) == len(b)
    assert a == b, [x for x in zip(a, b) if x[0] != x[1]][:3]
