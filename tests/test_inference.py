from __future__ import annotations

import re
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import providers
from feedloom.operators import inference
from feedloom.plans.enrich import enrich, prepare
from feedloom.schemas import CLASSIFICATION


def test_retry_pauses_and_gives_up():
    pauses, calls = [], []

    def fail():
        calls.append(1)
        raise OSError("no")

    with pytest.raises(OSError):
        inference.call_with_retry(fail, pauses.append)
    assert len(calls) == 3 and pauses == [1.0, 2.0]


def test_retry_recovers():
    left = [OSError("no"), "fine"]

    def flaky():
        value = left.pop(0)
        if isinstance(value, Exception):
            raise value
        return value

    assert inference.call_with_retry(flaky, lambda s: None) == "fine"


def test_two_pass(spark):
    texts = ["good", "repair me", "never", "down", "silent", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = inference.classify_two_pass(df, providers.MoodyChat, pause=providers.no_pause).orderBy("i").collect()
    assert [r.classification is not None for r in got] == [True, True, False, False, False, False, False]
    assert [r.asked_twice for r in got] == [False, True, True, False, False, False, False]
    errors = [r.classification_error for r in got]
    assert errors[:2] == [None, None] and errors[5:] == [None, None]
    assert errors[2] == "answer does not match the schema"
    assert errors[3] == "ConnectionError: down" and errors[4] == "ValueError: empty answer"
    assert got[0].classification.tickers == ["XAG", "XAU"]


def test_embed_isolates_bad_texts(spark):
    texts = ["abc", "bad one", "", None, "de"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1)
    got = df.select("i", inference.embed("t", providers.PickyEmbedder, providers.no_pause).alias("e")).orderBy("i").collect()
    assert [r.e.embedding for r in got] == [[3.0, 1.0], None, None, None, [2.0, 1.0]]
    assert [r.e.error for r in got] == [None, "ValueError: bad text", None, None, None]


def embedded(spark, provider, texts, **options):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1)
    return [r.e for r in df.select("i", inference.embed("t", provider, providers.no_pause, **options).alias("e")).orderBy("i").collect()]


def test_a_short_reply_is_a_failed_request(spark):
    got = embedded(spark, providers.ShortEmbedder, ["a", "b", "c", "d"])
    assert [r.embedding for r in got] == [[1.0, 2.0]] * 4 and all(r.error is None for r in got)


def test_requests_are_bounded_and_halved(spark):
    assert {r.embedding[0] for r in embedded(spark, providers.SizedEmbedder, ["t"] * 40, batch_size=8)} == {8.0}
    assert {r.embedding[0] for r in embedded(spark, providers.SizedEmbedder, ["t"] * 40, batch_size=40)} == {10.0}


def test_a_provider_that_is_down_fails_the_task(spark):
    for n in (1, 3000):
        with pytest.raises(Exception, match="ProviderDown: ConnectionError: down after"):
            embedded(spark, providers.DownEmbedder, ["t"] * n)
    df = spark.createDataFrame([(i, "t") for i in range(40)], "i int, text string").coalesce(1)
    for n in (1, 8):
        with pytest.raises(Exception, match="ProviderDown: ConnectionError"):
            inference.classify_two_pass(df, providers.DownChat, pause=providers.no_pause, concurrency=n).collect()


def test_a_provider_that_goes_down_fails_the_task(spark):
    with pytest.raises(Exception, match="ProviderDown"):
        embedded(spark, providers.TiringEmbedder, ["t"] * 100, batch_size=8)


def test_many_bad_texts_take_none_of_the_later_ones(spark):
    texts = ["down"] * 20 + ["good"] * 30
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").coalesce(1)
    for n in (1, 8):
        got = inference.classify_two_pass(df, providers.MoodyChat, pause=providers.no_pause, concurrency=n).orderBy("i").collect()
        assert [r.classification is not None for r in got] == [t == "good" for t in texts]
    texts = ["bad"] * 90 + ["good"] * 50 + ["bad"] * 3 + ["good"] * 7
    for size in (256, 20):
        got = embedded(spark, providers.PickyEmbedder, texts, batch_size=size)
        assert [r.embedding is not None for r in got] == [t == "good" for t in texts]


def test_lists_of_conversations(spark):
    texts = ["one", "two", "broken", "four", "five", "six", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").coalesce(1)
    got = inference.classify_two_pass(df, providers.ManyChat, pause=providers.no_pause, batch_size=4).orderBy("i").collect()
    assert [r.classification is not None for r in got] == [True, True, False, True, True, True, False]
    assert got[2].classification_error == "ConnectionError: broken"


def test_conversations_are_under_way_together(spark):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(12)], "i int, text string").coalesce(1)
    for n in (1, 4):
        got = inference.classify_two_pass(df, providers.SlowChat, pause=providers.no_pause, concurrency=n).collect()
        assert max(int(r.classification.tickers[0]) for r in got) == n


def test_hashing_embedder():
    a, b, empty, blank = inference.HashingEmbedder(16).embed(["up up down", "down UP, up!", "", "  "])
    assert list(a) == list(b) and sum(x * x for x in a) == pytest.approx(1.0)
    assert set(empty) == {0.0} == set(blank)


ITEM = "source string, source_id string, author string, published_at timestamp, lang string, text string, raw string"


def item(spark, *texts):
    rows = [("reddit", str(i), None, None, "en", t, "{}") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, ITEM)


def test_enrich_with_stub_models(spark):
    def chat(df):
        return inference.classify_two_pass(df, providers.GoodChat)

    rows = enrich(prepare(item(spark, "silver fades", "silver fades", "")), None, chat, providers.TripleEmbedder)
    got = {r.source_id: r for r in rows.collect()}
    assert set(got) == {"0", "2"}
    assert got["0"].topics == ["regulation"] and got["0"].embedding == [0.25, -0.5, 12.0]
    assert got["2"].topics == [] and got["2"].sentiment is None and got["2"].embedding is None


def test_cached_texts_are_not_embedded_again(spark):
    unique = prepare(item(spark, "a", "b"))
    cache = unique.select("content_hash", F.array(F.lit(7.0).cast("float")).alias("embedding"), F.lit(1).alias("written_at"))
    rows = enrich(unique, cache, embedder=providers.NoNewTexts).collect()
    assert [r.embedding for r in rows] == [[7.0], [7.0]] and all(r.embedding_reused for r in rows)
    assert all(r.embedding_error is None for r in rows)


class Measured:
    """Answers with how many texts and bytes it was asked for at once."""

    batch_size = 1 << 16

    def embed(self, texts):
        return [[float(len(texts)), float(sum(len(t.encode()) for t in texts))] for _ in texts]


def test_requests_are_bounded_in_bytes(spark):
    texts = ["é" * 5_000] * 700 + ["", None] + ["x" * 3_000_000] + ["y" * 10] * 3_000
    got = embedded(spark, Measured, texts)
    assert [r.embedding is None for r in got] == [not t for t in texts]
    most = inference.REQUEST_BYTES
    # One request has the long text, and no more of others than a request holds; short texts still go together.
    over = {tuple(r.embedding) for r in got if r.embedding and r.embedding[1] >= most + 10_000}
    assert len(over) == 1 and got[702].embedding[1] < 3_000_000 + most and got[-1].embedding[0] > 500


def test_python_gets_batches_bounded_in_bytes(spark):
    @F.arrow_udf("long")
    def size(batch: pa.Array) -> pa.Array:
        return pa.array([batch.nbytes] * len(batch), pa.int64())

    long = spark.range(9_000, numPartitions=1).select(F.repeat(F.lit("x"), 3_000).alias("t"))
    assert long.select(F.max(size("t"))).first()[0] < 5 << 20


def test_hashing_in_parts_equals_hashing_at_once(spark):
    texts = [f"w{i % 700} w{i % 31} up, w{i} " * 60 for i in range(5_000)]
    got = embedded(spark, inference.HashingEmbedder, texts)
    assert [r.embedding for r in got] == [v.tolist() for v in inference.HashingEmbedder().embed(texts)]


def test_requests_beside_a_cache_are_bounded_in_bytes(spark):
    unique = prepare(item(spark, *[f"{i} " + "x" * 20_000 for i in range(400)])).coalesce(1)
    cache = unique.filter("source_id % 2 = 0").select("content_hash", F.array(F.lit(7.0).cast("float")).alias("embedding"), F.lit(1).alias("written_at"))
    got = enrich(unique, cache, embedder=Measured).select("embedding", "embedding_reused").collect()
    new = [r.embedding for r in got if not r.embedding_reused]
    assert len(new) == 200 == len(got) - len(new)
    assert all(size < inference.REQUEST_BYTES + 25_000 for _, size in new)


class Peaked(inference.HashingEmbedder):
    """Answers with the MB by which its process has grown at most since the embedder was made."""

    def __init__(self):
        super().__init__()
        Path("/proc/self/clear_refs").write_text("5")
        self.before = self.peak()

    def peak(self):
        return int(re.search(r"VmHWM:\s+(\d+)", Path("/proc/self/status").read_text())[1]) / 1024

    def embed(self, texts):
        super().embed(texts)
        return [[self.peak() - self.before] for _ in texts]


def test_memory_of_embedding_beside_a_cache_does_not_follow_the_batch(spark, tmp_path):
    # 20 MB of posts whose words differ, a fifth of them stored before, as enrich_into_store meets them.
    words = F.transform(F.sequence(F.lit(1), F.lit(2_500)), lambda i: F.concat(F.hex(F.col("id") * 2_500 + i), F.lit("-é")))
    posts = spark.range(1_000, numPartitions=1).select(F.lit("reddit").alias("source"), F.array_join(words, " ").alias("text"), F.md5(F.col("id").cast("string")).alias("content_hash"))
    posts.write.parquet(str(tmp_path / "posts"))
    unique = spark.read.parquet(str(tmp_path / "posts"))
    cache = spark.range(0, 1_000, 5).select(F.md5(F.col("id").cast("string")).alias("content_hash"), F.array(F.lit(-1.0).cast("float")).alias("embedding"), F.lit(1).alias("written_at"))
    unlabelled = {"classification": F.lit(None).cast(CLASSIFICATION), "classification_error": F.lit(None).cast("string")}
    got = enrich(unique, cache, lambda df: df.withColumns(unlabelled), Peaked).select(F.col("embedding")[0].alias("mb"), "embedding_reused").collect()
    grown = [r.mb for r in got if not r.embedding_reused]
    assert len(got) == 1_000 and len(grown) == 800
    assert max(grown) < 120
