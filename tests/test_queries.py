"""Every registered query against its DuckDB twin on the smallest tables."""

import pytest

import compare
from __spark_entry__ import entry
from ledgerspark.oracles import all_sql
from ledgerspark.registry import QUERIES

SF = "/root/testdata/sf0.001"
TWINS = all_sql()
ROWS_ONLY = {"rag_chunks", "knn_indexed", "rag_passages"}


@pytest.fixture(scope="module")
def duck():
    return compare.connect(SF)


def test_every_query_has_a_twin():
    assert set(QUERIES) - set(TWINS) == ROWS_ONLY
    assert set(TWINS) <= set(QUERIES)


def test_entry(spark):
    assert entry(spark).count() > 0


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    text, _ = compare.compare(spark, duck, SF, name, QUERIES[name], TWINS.get(name))
    assert text.split()[0] in ("exact", "close", "rows-only"), text
