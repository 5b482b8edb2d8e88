"""The subpackage's queries against their SQL, and the others' shape, on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from credograph.llm import queries

SF = "/root/testdata/sf0.001"
COLUMNS = {"p4_found": ["extraction_id", "field_name", "entity_id"], "p9_found": ["doc_id", "item_id"], "p10_found": ["doc_id"]}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows(spark, con, name):
    got = queries.QUERIES[name](spark, SF)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.SQL[name]})").fetchall()
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, want))


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, name):
    df = queries.QUERIES[name](spark, SF)
    assert df.columns == COLUMNS[name]
    assert df.count() == df.distinct().count() > 0
