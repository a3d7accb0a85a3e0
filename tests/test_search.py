from __future__ import annotations

import random
from datetime import datetime, timedelta, timezone

import numpy as np
import pyarrow as pa
import pytest

from feedloom.functions import vectors
from feedloom.operators import search, topic_index, vector_index
from feedloom.operators.search import SearchFilters

AS_OF = datetime(2024, 2, 1, tzinfo=timezone.utc)
SCHEMA = (
    "source string, source_id string, author string, published_at timestamp, topics array<string>,"
    " sentiment int, stance string, impact int, text string, embedding array<float>"
)


WEST, EAST = [3.0, 0.0, 4.0, 0.0], [0.0, 5.0, 0.0, 12.0]


@pytest.fixture(scope="module")
def items(spark):
    """Five posts of three feeds; two of them have no usable vector."""
    rows = [
        ("telegram", "tg:70", "ilse", AS_OF - timedelta(hours=30), ["regulation", "markets"], 1, "bullish", 2, "Custody rules eased", WEST),
        ("truth_social", "ts-8", None, AS_OF - timedelta(days=12), ["macro"], -1, "bearish", 1, "Freight rates slide", EAST),
        ("reddit", "t3_z", "bo", AS_OF - timedelta(days=2), None, 0, "neutral", 0, "Weekly thread", [3.0, 5.0, 4.0, 12.0]),
        ("telegram", "tg:71", "ilse", AS_OF, ["regulation"], 1, "bullish", 0, "Not embedded yet", None),
        ("reddit", "t3_y", None, AS_OF, ["regulation", None], None, None, None, "Embedding came back empty", []),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def ids(df):
    return [r.source_id for r in df.collect()]


def test_three_filters_together(items):
    filters = SearchFilters(topics=["markets", "macro"], stance="bullish", since_days=3)
    hits = search.semantic_search(items, [6.0, 0.0, 8.0, 0.0], filters, as_of=AS_OF).collect()
    assert [(h.source_id, round(h.score, 9)) for h in hits] == [("tg:70", 1.0)]


class Compass:
    """Points east or west, as the text says."""

    def embed(self, texts):
        return [np.array(EAST if "east" in t else WEST, dtype=np.float32) for t in texts]


def test_search_by_text(items):
    assert ids(search.search_by_text(items, "go west", Compass, limit=2)) == ["tg:70", "t3_z"]
    assert ids(search.search_by_text(items, "back east", Compass, limit=2)) == ["ts-8", "t3_z"]


def test_no_filter_skips_missing_vectors(items):
    assert ids(search.semantic_search(items, WEST)) == ["tg:70", "t3_z", "ts-8"]
    assert ids(search.semantic_search(items, WEST, limit=1)) == ["tg:70"]


@pytest.mark.parametrize(
    "filters, expected",
    [
        (SearchFilters(sentiment=0), ["t3_z"]),
        (SearchFilters(stance="", since_days=0, topics=[]), ["tg:70", "t3_z", "ts-8"]),
        (SearchFilters(since_days=2), ["tg:70", "t3_z"]),
        (SearchFilters(topics=["macro", "markets"]), ["tg:70", "ts-8"]),
        (SearchFilters(topics=["crypto"]), []),
    ],
)
def test_single_filters(items, filters, expected):
    assert ids(search.semantic_search(items, WEST, filters, as_of=AS_OF)) == expected


def test_recency_needs_as_of(items):
    with pytest.raises(ValueError):
        search.semantic_search(items, WEST, SearchFilters(since_days=1))


def test_result_view(items):
    row = search.search_result_view(search.semantic_search(items, [3.0, 5.0, 4.0, 12.5])).first()
    assert (row.item, row.score, row.topics, row.stance) == ("reddit:t3_z", 1.0, [], "neutral")


CASES = [
    ([1.0, 0.0], [1.0, 0.0], 1.0),
    ([1.0, 0.0], [0.0, 1.0], 0.0),
    ([0.0, 0.0], [1.0, 2.0], 0.0),
    ([1.0, 2.0], [3.0], 3 / (5**0.5 * 3)),
]


@pytest.mark.parametrize("a, b, expected", CASES)
def test_cosine(spark, a, b, expected):
    df = spark.createDataFrame([(a, b)], "a array<float>, b array<float>")
    row = df.select(vectors.cosine_similarity("a", "b").alias("jvm"), vectors.cosine_to(b, "a").alias("arrow")).first()
    assert row.jvm == pytest.approx(expected) and row.arrow == pytest.approx(expected)


def brute(rows, queries, k):
    found = set()
    for q, v in queries:
        scored = []
        for key, e in rows:
            n = min(len(v), len(e))
            a, b = np.array(e, dtype=np.float32).astype(float), np.array(v, dtype=np.float32).astype(float)
            norm = np.linalg.norm(a) * np.linalg.norm(b)
            scored.append((round(float(a[:n] @ b[:n] / norm), 9) if norm else 0.0, key))
        for rank, (score, key) in enumerate(sorted(scored, key=lambda x: (-x[0], x[1]))[:k], 1):
            found.add((q, rank, key, round(score, 6) + 0.0))
    return found


@pytest.mark.parametrize("at_once", [10_000, 7])
def test_many_queries_equal_brute_force(spark, monkeypatch, at_once):
    """A third of the rows are copies of one vector, and vectors differ in length."""
    monkeypatch.setattr(search, "ITEMS_AT_ONCE", at_once)
    monkeypatch.setattr(search, "QUERIES_AT_ONCE", at_once)
    rng = random.Random(3)
    grid = [-1.0, 0.0, 0.5, 2.0]
    rows = [(f"{i:04d}", [rng.choice(grid) for _ in range(rng.choice([2, 3]))]) for i in range(200)]
    rows += [(f"{i:04d}", [1.0, 0.5, 0.0]) for i in range(200, 300)]
    queries = [(i, [rng.choice(grid) for _ in range(rng.choice([2, 3]))]) for i in range(20)] + [(99, [1.0, 0.5, 0.0])]
    items = spark.createDataFrame(rows, "source_id string, embedding array<float>").repartition(5)
    asked = spark.createDataFrame([*queries, (100, None), (101, [])], "query_id long, embedding array<float>").repartition(3)
    hits = search.semantic_search_multi(items, asked, k=6).collect()
    assert {(h.query_id, h.rank, h.source_id, round(h.score, 6) + 0.0) for h in hits} == brute(rows, queries, 6)
    assert len(hits) == 6 * len(queries)


def test_a_task_hands_out_queries_times_k_rows_at_most():
    rng = np.random.default_rng(1)
    kept, out, chunks = search.BestPerQuery(["source_id"], 5), [], 40
    block = pa.table({"query_id": np.arange(30), "embedding": rng.normal(size=(30, 4)).tolist()})
    rows = rng.normal(size=(chunks * 50, 4)).round(1)
    for i in range(chunks):
        names = [f"{j:05d}" for j in range(50 * i, 50 * i + 50)]
        out += kept.add(0, pa.table({"source_id": names, "embedding": rows[50 * i : 50 * i + 50].tolist()}), block)
        assert sum(t.num_rows for t in kept.held.values()) <= 150
    assert out == []
    out = pa.Table.from_batches(list(kept.flush()))
    assert out.num_rows == 150 and not kept.held
    queries = [(r["query_id"], r["embedding"]) for r in block.to_pylist()]
    score = vectors.cosine_matrix(rows, np.array([v for _, v in queries])).round(12)
    want = {(q, f"{j:05d}") for q in range(30) for j in sorted(range(len(rows)), key=lambda j: (-score[j, q], j))[:5]}
    assert set(zip(out["query_id"].to_pylist(), out["source_id"].to_pylist())) == want
    # Beyond its bound a task hands out early; nothing is lost.
    small, early = search.BestPerQuery(["source_id"], 5, most_rows=200), []
    for i in range(chunks):
        names = [f"{j:05d}" for j in range(50 * i, 50 * i + 50)]
        for number in (0, 1):
            early += small.add(number, pa.table({"source_id": names, "embedding": rows[50 * i : 50 * i + 50].tolist()}), block.slice(15 * number, 15))
    early += small.flush()
    assert want <= {p for b in early for p in zip(b["query_id"].to_pylist(), b["source_id"].to_pylist())}


# ---- index --------------------------------------------------------------------------


@pytest.mark.parametrize("cells", [None, 1, 300])
def test_the_index_is_exact(spark, cells):
    """Copies of one vector in a third of the rows, zero vectors, vectors and queries of other lengths."""
    rng = random.Random(3)
    grid = [-1.0, 0.0, 0.5, 2.0]
    rows = [(f"{i:04d}", [rng.choice(grid) for _ in range(rng.choice([2, 3, 3, 3]))]) for i in range(200)]
    rows += [(f"{i:04d}", [1.0, 0.5, 0.0]) for i in range(200, 300)] + [("0300", [0.0, 0.0, 0.0]), ("0301", [0.0, 0.0])]
    queries = [(i, [rng.choice(grid) for _ in range(rng.choice([2, 3]))]) for i in range(20)] + [(98, [0.0] * 3), (99, [1.0, 0.5, 0.0])]
    items = spark.createDataFrame([*rows, ("0302", None), ("0303", [])], "source_id string, embedding array<float>").repartition(5)
    asked = spark.createDataFrame([*queries, (100, None), (101, [])], "query_id long, embedding array<float>").repartition(3)
    index = vector_index.build_index(items, cells=cells)
    assert index.rows(spark).count() == len(rows)
    for probes in (1, 3):
        hits = vector_index.search_indexed(index, asked, k=6, probes=probes).collect()
        assert {(h.query_id, h.rank, h.source_id, round(h.score, 6) + 0.0) for h in hits} == brute(rows, queries, 6)


def test_the_index_prunes_and_its_recall_is_measured(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 16))
    points = centres.repeat(50, axis=0) + rng.normal(size=(2000, 16)) * 0.15
    rows = [(f"{i:05d}", v.tolist()) for i, v in enumerate(points)]
    items = spark.createDataFrame(rows, "source_id string, embedding array<float>").repartition(4)
    asked = spark.createDataFrame([(i, points[i].tolist()) for i in range(0, 2000, 100)], "query_id long, embedding array<float>")
    index = vector_index.build_index(items, sample_rows=500)
    probes, reached = vector_index.probes_for(index, asked, 10)
    assert reached >= 0.9 and probes < len(index.centroids) / 2
    queries = [(i, points[i].tolist()) for i in range(0, 2000, 100)]
    hits = vector_index.search_indexed(index, asked, k=10, probes=2).collect()
    assert {(h.query_id, h.rank, h.source_id, round(h.score, 6)) for h in hits} == brute(rows, queries, 10)
    # The second pass of a query reads few of the other cells.
    block = pa.table({"query_id": [0], "embedding": [points[0].tolist()]})
    first = vector_index._planned(index, block, 2, None)
    second = vector_index._planned(index, block, 2, np.array([0.9]))
    assert len(first) == 3 and len(second) < len(index.centroids) / 4
    plan = index.rows(spark).filter("cell IN (1, 2)")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan


def test_an_index_of_nothing(spark):
    none = spark.createDataFrame([], "source_id string, embedding array<float>")
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<float>")
    assert vector_index.search_indexed(vector_index.build_index(none), asked).count() == 0
    some = spark.createDataFrame([("a", [1.0, 0.0])], "source_id string, embedding array<float>")
    assert vector_index.search_indexed(vector_index.build_index(some), asked.limit(0)).count() == 0


def test_topics_cut_folders_and_rows(spark):
    rng = random.Random(12)
    names = ["crypto", "macro", "regulation", None]
    rows = []
    for i in range(900):
        source = "reddit" if i % 3 else rng.choice(["telegram", None])
        day = None if i % 50 == 0 else AS_OF - timedelta(days=rng.randrange(5))
        topics = None if i % 11 == 0 else rng.sample(names, rng.randrange(0, 4)) + ["macro"] * (i % 2)
        rows.append((source, f"s{i}", day, ["rare"] if i == 77 else topics, i))
    items = spark.createDataFrame(rows, "source string, source_id string, published_at timestamp, topics array<string>, bucket int").repartition(4)
    index = topic_index.build_topic_index(items)
    for wanted in (["macro"], ["crypto", "regulation"], ["rare"], ["none"], []):
        got = topic_index.items_with_topics(index, spark, wanted)
        assert sorted(got.columns) == sorted(items.columns)
        assert {r.source_id for r in got.collect()} == {r[1] for r in rows if set(wanted) & set(r[3] or [])}
        assert got.count() == len({r[1] for r in rows if set(wanted) & set(r[3] or [])})
    # One folder holds the rare topic, and only its files are read.
    plan = topic_index.items_with_topics(index, spark, ["rare"])._jdf.queryExecution().executedPlan().toString()
    filters = [line.split("PartitionFilters: [")[1].split("]")[0] for line in plan.splitlines() if "PartitionFilters: [" in line]
    assert any("source#" in f and "day#" in f for f in filters)
    empty = topic_index.build_topic_index(items.limit(0))
    assert topic_index.items_with_topics(empty, spark, ["macro"]).count() == 0


def test_no_queries_no_hits(items, spark):
    none = spark.createDataFrame([], "query_id int, embedding array<float>")
    hits = search.semantic_search_multi(items, none)
    assert hits.count() == 0 and dict(hits.dtypes)["query_id"] == "int"


def test_many_queries_are_one_pass(items, spark):
    asked = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(50)], "query_id int, embedding array<float>")
    plan = search.semantic_search_multi(items, asked)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Union" not in plan and "Broadcast" not in plan


def test_winners_are_joined_back(items):
    hits = search.semantic_search(items.select("source", "source_id", "embedding"), WEST, limit=2)
    rows = search.join_winners(items, hits).collect()
    assert [(r.source_id, r.author, round(r.score, 3)) for r in rows] == [("tg:70", "ilse", 1.0), ("t3_z", "bo", 0.359)]


def test_topic_condition_is_never_null(spark):
    df = spark.createDataFrame([(None,), ([None],), (["crypto"],)], "topics array<string>")
    assert [r[0] for r in df.select(search.any_topic(["crypto"])).collect()] == [False, False, True]


def test_plan_is_a_top_k(items):
    plan = search.semantic_search(items, WEST, SearchFilters(sentiment=1))._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan.split("Physical Plan")[1]
