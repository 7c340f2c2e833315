from __future__ import annotations

import check
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from pathpulse.llm.queries import ORACLES, QUERIES
from pathpulse.llm.store import keep


def test_operators_and_the_pipeline_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert {*QUERIES, "pipeline"} <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_agrees_with_sql(spark, small, name):
    assert check.compare(spark, check.connect(small), QUERIES[name], ORACLES[name], small) == ""


def test_pipeline_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = keep(stage(spark, docs, small))
        assert docs.columns == columns, name
        assert 0.6 * n < docs.count() <= n
    last = keep(corpus_pipeline.packing(spark, docs, small))
    assert {r.doc_id for r in last.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}


def test_stages_of_an_empty_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = keep(stage(spark, docs, small))
    assert docs.count() == 0
