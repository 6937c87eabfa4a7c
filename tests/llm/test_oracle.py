"""Corpus queries with SQL, compared with DuckDB over the smallest tables."""

import os
import sys

import duckdb
import pytest

pytest.importorskip("public_tokenizers")

from panelspark.llm.queries import ORACLE, QUERIES

sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", "..", "scripts"))
from check_oracle import rows_of  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(f"{SF}/documents.parquet"), reason="driver tables not present")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", list(ORACLE))
def test_query_matches_duckdb(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.execute(ORACLE[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of(columns, want.fetchall())
