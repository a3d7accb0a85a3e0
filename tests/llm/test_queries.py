"""The registered queries of the folder and the pipeline on the smallest tables."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from compare import connect, difference
from feedloom.llm.oracles import SQL
from feedloom.llm.queries import QUERIES

SF_DIR = os.environ.get("SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    assert difference(QUERIES[name](spark, SF_DIR), connect(SF_DIR), SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_covers_its_table(spark, name):
    table, key = ("embeddings", "vec_id") if name in ("op7_vectors", "op11_whitening") else ("documents", "doc_id")
    ids = {r[0] for r in spark.read.parquet(f"{SF_DIR}/{table}.parquet").select(key).collect()}
    assert {r[0] for r in QUERIES[name](spark, SF_DIR).select(key).collect()} == ids


def test_all_operators_are_registered():
    names = entry.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)) and "pipeline" in names


def test_stages_hand_on_documents(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, before = docs.columns, docs.count()
    odd = spark.createDataFrame(
        [(None, None, None, None, None), (90_001, "", "en", "x", 0), (90_001, "", "en", "x", 0), (90_002, "é " * 30_000, None, None, None)], docs.schema
    )
    docs = docs.unionByName(odd)
    from feedloom.llm.common import written

    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, SF_DIR), name)
        assert docs.columns == columns
        assert 0 < docs.count() <= before + 4
    assert docs.count() == docs.select("doc_id").distinct().count()
    pieces = written(corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR), "packed")
    assert {r[0] for r in pieces.select("doc_id").distinct().collect()} == {r[0] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF_DIR).count() == 0
