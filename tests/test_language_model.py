"""The learned language detector: held-out rows, short texts, odd rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from feedloom.operators import language_model as lm
from feedloom.plans.inputs import hashed

DOCS = "/root/testdata/sf0.01/documents.parquet"


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet(DOCS).select("doc_id", "lang", "text")
    return lm.fit_language_model(docs.filter(hashed("doc_id", 5) != 0))


def held_out(spark):
    return spark.read.parquet(DOCS).select("doc_id", "lang", "text").filter(hashed("doc_id", 5) == 0)


def agreement(rows, model):
    found = lm.detect_languages(rows, model).join(rows.select("doc_id", "lang"), "doc_id")
    return found.filter("detected IS NOT NULL").agg(F.avg((F.col("detected") == F.col("lang")).cast("double"))).first()[0]


def test_held_out_rows(spark, model):
    assert agreement(held_out(spark), model) >= 0.99


@pytest.mark.parametrize("n, least", [(5, 0.99), (3, 0.98), (1, 0.93)])
def test_short_texts(spark, model, n, least):
    rows = held_out(spark).withColumn("w", lm.words("text")).filter(F.size("w") >= 30)
    rows = rows.withColumn("text", F.array_join(F.slice("w", 11, n), " ")).drop("w")
    assert agreement(rows, model) >= least


def test_odd_rows(spark, model):
    rows = [(1, None), (2, ""), (3, " 12 !? "), (4, "Это не она"), (5, "the the and of"), (6, "nicht und die der " * 20_000), (7, "x"), (7, "the and of with")]
    docs = spark.createDataFrame([(i, t, "q", 1.0) for i, t in rows], "doc_id long, text string, gram string, score double")
    got = {r.doc_id: r for r in lm.detect_languages(docs, model).collect()}
    assert set(got) == set(range(1, 8)) and all(got[i].detected is None and got[i].score is None for i in (1, 2, 3))
    assert got[5].detected == "en" and got[6].detected == "de" and got[7].detected == "en" and got[4].score < -5
    assert lm.detect_languages(docs.limit(0), model).count() == 0
    empty = lm.fit_language_model(docs.select("doc_id", "text", F.lit(None).cast("string").alias("lang")))
    assert {r.detected for r in lm.detect_languages(docs, empty).collect()} == {None}


def test_profiles_are_bounded(spark):
    docs = spark.read.parquet(DOCS).select("doc_id", "lang", "text")
    small = lm.fit_language_model(docs, sample_rows=5, most_grams=300)
    assert small.profile.count() == 300 and len(small.languages) == docs.select("lang").distinct().count()
    plan = lm.detect_languages(docs, small)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and plan.count("Exchange hashpartitioning") == 1
