"""Registered queries on given tables: twins where SQL can say them, and the pipeline."""

import os

import pytest

import corpus_pipeline
from aqspark.llm import registry
from aqspark.session import settle
from twin import differences, twin_connection

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
registry.load()


@pytest.fixture(scope="module")
def con():
    return twin_connection(SF_DIR)


@pytest.mark.parametrize("name", sorted(registry.TWINS))
def test_twin(spark, con, name):
    assert differences(registry.QUERIES[name](spark, SF_DIR), con, registry.TWINS[name]) == []


def test_all_operators_are_registered():
    assert [sum(q.startswith(f"op{n}_") for q in registry.QUERIES) for n in range(1, 14)] == [1] * 13


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):


        docs = settle(stage(spark, docs, SF_DIR))
        counts.append(docs.count())
        assert k == 4 or docs.columns == columns, name
    assert counts[0] > counts[1] > counts[2] == counts[3] and counts[5] > 0
    assert sum(r.length for r in docs.collect()) > 0
    nothing = spark.createDataFrame([], spark.read.parquet(f"{SF_DIR}/documents.parquet").schema)
    for _, stage in corpus_pipeline.STAGES:
        nothing = settle(stage(spark, nothing, SF_DIR))
    assert nothing.count() == 0
