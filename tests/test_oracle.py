"""Every query that has SQL gives what DuckDB gives on the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
CORE = [m for m in entry._modules() if not m.__name__.startswith("credograph.llm")]
SQL = {k: v for m in CORE for k, v in m.SQL.items()}
QUERIES = {k: v for m in CORE for k, v in m.QUERIES.items()}


def _cell(x):
    if x is None or isinstance(x, float) and math.isnan(x) or x is pd.NaT or x is pd.NA:
        return None
    if isinstance(x, float) or hasattr(x, "dtype") and x.dtype.kind == "f":
        return round(float(x), 6) + 0.0
    return str(x)


def rows(df: pd.DataFrame) -> list[tuple]:
    return sorted((tuple(map(_cell, r)) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)


@pytest.fixture(scope="session")
def con():
    if not os.path.isdir(SF):
        pytest.skip("no test data")
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, con, name):
    got, want = QUERIES[name](spark, SF).toPandas(), con.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, con, name):
    assert QUERIES[name](spark, SF).count() > 0
