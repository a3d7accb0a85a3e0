"""Dedup, ranking and constraints against plain Python, with one hot group."""

from __future__ import annotations

import hashlib
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from feedloom.operators import constraints, dedup, marks, ranking

T0 = datetime(2024, 1, 1)


def posts(n=600, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        hot = rng.random() < 0.34
        rows.append(("reddit" if hot else rng.choice(["twitter", "telegram"]), i, "same text" if hot else f"t{rng.randint(0, 80)}", T0 + timedelta(minutes=rng.randint(0, 300))))
    return rows


SCHEMA = "source string, seq long, text string, published_at timestamp"


def test_keep_first(spark):
    rows = posts()
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    got = {(r.source, r.text): r.seq for r in dedup.keep_first(dedup.mark_hash(df), [F.col("seq")]).collect()}
    want = {}
    for source, seq, text, _ in rows:
        want.setdefault((source, text), seq)
    assert got == want


def test_keep_first_limits_groups_before_the_shuffle(spark):
    df = dedup.mark_hash(spark.createDataFrame(posts(), SCHEMA))
    plan = dedup.keep_first(df, [F.col("seq")])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_same_text_of_two_sources_stays(spark):
    df = spark.createDataFrame([("reddit", 1, "Hello world", T0), ("reddit", 2, "Hello world", T0), ("twitter", 3, "Hello world", T0), ("reddit", 4, "", T0), ("reddit", 5, "", T0)], SCHEMA)
    kept = dedup.keep_first(dedup.mark_hash(df), [F.col("seq")])
    assert sorted(r.seq for r in kept.collect()) == [1, 3, 4]
    assert {r.source: r.n_items for r in marks.batch_counts(kept).collect()} == {"reddit": 2, "twitter": 1}


def test_existing_hash_is_kept(spark):
    df = spark.createDataFrame([("reddit", "a", "given"), ("reddit", "a", None), ("reddit", "a", "")], "source string, text string, content_hash string")
    own = hashlib.sha256(b"reddit::a").hexdigest()
    assert sorted(r.content_hash for r in dedup.mark_hash(df).collect()) == sorted(["given", own, own])


def test_cache(spark):
    items = spark.createDataFrame([("h1", "a"), ("h2", "b"), ("h3", "")], "content_hash string, text string")
    cache = spark.createDataFrame([("h1", [1.0], 1), ("h1", [2.0], 2), ("h9", [9.0], 1)], "content_hash string, embedding array<float>, written_at long")
    got = {r.content_hash: r.cached_embedding for r in dedup.attach_cached(items, cache).collect()}
    assert got == {"h1": [2.0], "h2": None, "h3": None}
    assert [r.content_hash for r in dedup.cache_hits(items, cache).collect()] == ["h1"]
    assert [r.content_hash for r in dedup.cache_misses(items, cache).collect()] == ["h2"]


def test_newest_per_feed(spark):
    rows = posts()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {(r.source, r.seq) for r in ranking.newest_per_feed(df, ["source"], 10, "seq").collect()}
    want = set()
    for source in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == source), key=lambda r: (-r[3].timestamp(), r[1]))
        want |= {(source, r[1]) for r in mine[:10]}
    assert got == want


def test_top_k_per_group(spark):
    rows = posts()
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    got = {(r.source, r["rank"], r.seq) for r in ranking.top_k_per_group(df, ["source"], [F.col("text").desc(), F.col("seq")], 5, spread=3).collect()}
    want = set()
    for source in {r[0] for r in rows}:
        mine = sorted(sorted((r for r in rows if r[0] == source), key=lambda r: r[1]), key=lambda r: r[2], reverse=True)
        want |= {(source, i, r[1]) for i, r in enumerate(mine[:5], 1)}
    assert got == want


def test_chunks_over_many_runs(spark):
    rows = [(None if s == "telegram" else s, *rest) for s, *rest in posts()]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {(r.source, r.chunk_id): r["values"] for r in ranking.chunk_batches(df, ["source"], "seq", "seq", 7, run_bits=4).collect()}
    want = {}
    for source in {r[0] for r in rows}:
        mine = sorted(r[1] for r in rows if r[0] == source)
        want |= {(source, i // 7): mine[i : i + 7] for i in range(0, len(mine), 7)}
    assert got == want


def test_violations(spark):
    good = ("reddit", "1", "a", T0, "en", "", "{}")
    rows = [
        good,
        (None, *good[1:]),
        ("nope", *good[1:]),
        ("reddit", None, "x" * 256, None, "en-GB-", None, None),
        ("reddit", "i" * 256, *good[2:]),
    ]
    df = spark.createDataFrame(rows, "source string, source_id string, author string, published_at timestamp, lang string, text string, raw string")
    passed, failed = constraints.split_valid(df)
    assert passed.count() == 1
    assert sorted(sorted(r.violations) for r in failed.collect()) == sorted(
        [
            ["source missing"],
            ["source unknown"],
            ["author longer than 255", "lang longer than 5", "published_at missing", "raw missing", "source_id missing", "text missing"],
            ["source_id longer than 255"],
        ]
    )
    assert constraints.unknown_sources(df).count() == 2
    assert constraints.select_sources(df, ["reddit"]).count() == 3
    twice = df.union(df).filter("source_id = '1' AND source = 'reddit'")
    assert [r.n_rows for r in constraints.repeated_keys(twice, ["source", "source_id"]).collect()] == [2]
