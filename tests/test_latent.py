"""The offline embedder: against a plain SVD, and its neighbours against those of hashed words."""

from __future__ import annotations

import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from feedloom.operators import inference, latent


def corpus(seed, texts=600, topics=8):
    """Texts of 8 words of their topic's 60, so two texts of a topic share few words, and 4 of everybody's."""
    rng = random.Random(seed)
    rows = []
    for i in range(texts):
        t = rng.randrange(topics)
        words = rng.sample([f"t{t}w{j}" for j in range(60)], 8) + [f"common{rng.randrange(30)}" for _ in range(4)]
        rng.shuffle(words)
        rows.append((i, " ".join(words), t))
    return rows


def test_axes_equal_a_plain_svd(spark, tmp_path):
    rows = corpus(1, 120, 3)
    docs = spark.createDataFrame([*rows, (900, None, 0), (901, "", 0), (902, "!?", 0)], "doc_id long, text string, topic int").repartition(3)
    provider = latent.fit_latent(docs, str(tmp_path / "model"), size=5)
    model = provider()
    df = {}
    for _, t, _ in rows:
        for w in set(t.split()):
            df[w] = df.get(w, 0) + 1
    assert set(model.place) == {w for w, n in df.items() if n >= 2}
    assert all(abs(model.idf[i] - (np.log(124 / (1 + df[w])) + 1)) < 1e-12 for w, i in model.place.items())
    full = np.zeros((len(rows), len(model.place)))
    for r, (_, t, _) in enumerate(rows):
        for w in t.split():
            if w in model.place:
                full[r, model.place[w]] += 1
    full = np.where(full > 0, (1 + np.log(np.maximum(full, 1))) * model.idf, 0)
    full /= np.linalg.norm(full, axis=1, keepdims=True)
    _, s, vt = np.linalg.svd(full, full_matrices=False)
    got = np.linalg.norm(full @ model.axes, axis=0)
    assert np.allclose(model.axes.T @ model.axes, np.eye(5), atol=1e-9)
    # The captured strength is that of the best directions, but for a little of the randomness.
    assert (got[:3] > 0.995 * s[:3]).all() and (got > 0.95 * s[:5]).all()
    again = latent.fit_latent(docs.repartition(2), str(tmp_path / "again"), size=5)()
    assert np.allclose(model.axes, again.axes, atol=1e-6)


def test_embeddings_of_odd_texts(spark, tmp_path):
    docs = spark.createDataFrame(corpus(2, 100, 3), "doc_id long, text string, topic int")
    provider = latent.fit_latent(docs, str(tmp_path / "model"), size=4)
    rows = [(1, None), (2, ""), (3, "unknown words"), (4, "T0W1, t0w2!"), (5, "t0w1 t0w2 " * 30_000)]
    got = spark.createDataFrame(rows, "i int, text string").select("i", inference.embed("text", provider).alias("e")).collect()
    by = {r.i: r.e.embedding for r in got}
    assert by[1] is None and by[2] is None and not any(by[3])
    assert np.allclose(by[4], by[5], atol=1e-6) and abs(np.linalg.norm(by[4]) - 1) < 1e-6
    none = latent.fit_latent(docs.limit(0), str(tmp_path / "none"))
    assert len(none().embed(["a"])[0]) == 0


def test_neighbours_share_a_topic_more_often_than_by_hashed_words(spark, tmp_path):
    rows = corpus(3)
    docs = spark.createDataFrame(rows, "doc_id long, text string, topic int").repartition(3)
    provider = latent.fit_latent(docs, str(tmp_path / "model"), size=16, sample_rows=300)
    topic = np.array([t for *_, t in rows])

    def share(vectors):
        x = np.array(vectors, np.float64)
        score = x @ x.T
        np.fill_diagonal(score, -2)
        best = np.argsort(-score, axis=1)[:, :5]
        return (topic[best] == topic[:, None]).mean()

    texts = [t for _, t, _ in rows]
    by_meaning, by_hash = share(provider().embed(texts)), share(inference.HashingEmbedder(64).embed(texts))
    assert by_meaning > 0.85 and by_meaning > by_hash + 0.2, (by_meaning, by_hash)
    assert docs.select(inference.embed("text", provider).alias("e")).filter(F.size("e.embedding") == 16).count() == len(rows)


def test_a_batch_takes_little_memory_over_its_own(spark):
    rng = np.random.default_rng(0)
    rows = [(np.sort(rng.choice(5_000, 400, replace=False)).astype(np.int32), rng.random(400)) for _ in range(1_000)]
    batch = pa.RecordBatch.from_pydict({"at": pa.array([a.tobytes() for a, _ in rows], pa.binary()), "weight": pa.array([w.tobytes() for _, w in rows], pa.binary())})
    directions = rng.random((5_000, 80))
    tracemalloc.start()
    got = latent._times(batch, directions)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.allclose(got, [w @ directions[a] for a, w in rows])
    # The entries' directions all at once would be 256 MB.
    assert most < 10e6, most


def test_passes_equal_plain_products_over_many_tasks(spark):
    rng = np.random.default_rng(1)
    full = np.where(rng.random((500, 2_500)) < 0.02, rng.random((500, 2_500)), 0)
    entries = [(bytearray(np.flatnonzero(r).astype(np.int32).tobytes()), bytearray(r[r > 0].tobytes())) for r in full]
    rows = spark.createDataFrame(entries, "at binary, weight binary").repartition(37)
    directions = rng.random((2_500, 6))
    assert np.allclose(latent._back_and_forth(rows, directions), full.T @ (full @ directions))
    triangle = latent.tsqr(rows, directions)
    product = full @ directions
    assert np.allclose(triangle.T @ triangle, product.T @ product)


def test_every_text_is_fitted(spark, tmp_path):
    many = 110_000
    texts = [f"a{i % 50} b{i % 7}" + (" seldom" if i in (7, many - 7) else "") for i in range(many)]
    seldom = F.when(F.col("id").isin(7, many - 7), "seldom")
    text = F.concat_ws(" ", F.concat(F.lit("a"), F.col("id") % 50), F.concat(F.lit("b"), F.col("id") % 7), seldom)
    docs = spark.range(0, many, 1, 4).select(F.col("id").alias("doc_id"), text.alias("text"))
    model = latent.fit_latent(docs, str(tmp_path / "model"), size=8)()
    df = Counter(w for t in texts for w in t.split())
    assert set(model.place) == set(df)
    assert all(abs(model.idf[i] - (np.log((1 + many) / (1 + df[w])) + 1)) < 1e-12 for w, i in model.place.items())
    square = np.zeros((len(df), len(df)))
    for t, n in Counter(texts).items():
        at, weight = latent.tf_idf(t, model.place, model.idf)
        square[np.ix_(at, at)] += n * np.outer(weight, weight)
    best = np.sqrt(np.linalg.eigvalsh(square)[::-1][:8])
    got = np.sqrt(np.einsum("ij,ij->j", model.axes, square @ model.axes))
    assert np.allclose(got, best, rtol=0.005), (got, best)


def test_counts_in_parts_add_up():
    texts = [["b a b", None, "A!"], ["", "c d e", "a_c"]]
    parts = list(latent.text_counts((pa.RecordBatch.from_pydict({"text": pa.array(t, pa.string())}) for t in texts), at_once=2))
    assert len(parts) > 1
    total = {}
    for term, n in ((t, n) for p in parts for t, n in zip(p["term"].to_pylist(), p["n"].to_pylist())):
        total[term] = total.get(term, 0) + n
    assert total == {None: 6, "a": 3, "b": 1, "c": 2, "d": 1, "e": 1}


def test_terms_of_equal_counts_are_kept_by_name(spark):
    df = {f"w{i:02d}": 1 + i % 5 for i in range(40)}
    docs = spark.createDataFrame([(" ".join(w for w, n in df.items() if n > i),) for i in range(5)], "text string").repartition(3)
    order = sorted((-n, w) for w, n in df.items() if n >= 2)
    for terms in (0, 1, 8, 11, 24, 32, 99):
        count, kept = latent.frequent_terms(docs, terms, 2)
        assert (count, [(-r.n, r.term) for r in kept]) == (5, order[:terms])
    assert latent.frequent_terms(docs.limit(0), 5, 2) == (0, [])


def test_staged_rows_weigh_as_the_embedder_does():
    place, idf = {w: i for i, w in enumerate("abcdef")}, np.linspace(1, 2, 6)
    texts = ["f a a", "b", "c c c e d a", "e f"]
    rows = [latent.known_words(t, place) for t in texts]
    batch = pa.RecordBatch.from_pydict({name: pa.array([r[k].tolist() for r in rows], pa.list_(pa.int32())) for k, name in enumerate(("at", "n"))})
    for part, some in ((batch, texts), (batch.slice(1, 2), texts[1:3])):
        got = list(latent._weighed(part, idf))
        assert len(got) == len(some)
        for (at, weight), text in zip(got, some):
            plain_at, plain_weight = latent.tf_idf(text, place, idf)
            assert (at == plain_at).all() and np.allclose(weight, plain_weight)
