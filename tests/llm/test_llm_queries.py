"""Registered queries on the smallest tables, their SQL twins, and the pipeline stage by stage."""

import compare
import corpus_pipeline
import pytest
from conftest import SF

from __spark_entry__ import oracle_sql, queries
from ledgerspark.llm.queries import QUERIES, SQL


def test_registered():
    assert set(QUERIES) <= set(queries()) and "pipeline" in queries() and set(SQL) <= set(oracle_sql())
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    text, _ = compare.compare(spark, compare.connect(SF), SF, name, QUERIES[name], SQL.get(name))
    assert text.split()[0] in ("exact", "rows-only"), text


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "decontamination", "personal_data", "token_ids"]
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "token_ids":
            assert out.columns == docs.columns
        docs = corpus_pipeline.stored(out, name)
        counts.append(docs.count())
    assert counts[0] > counts[1] > counts[2] > counts[3] == counts[4] == counts[5] > 0
    assert corpus_pipeline.run(spark, SF).count() == counts[-1]
    left = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        left = corpus_pipeline.stored(stage(spark, left, SF), "empty")
        assert left.count() == 0
