"""Archives, sequences, classifiers, vectors and chats: round trips, brute force, held-out rows."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedloom.llm import chat, packing, quality, toxicity, vectors, warc
from feedloom.llm.common import connected_components, new_folder
from feedloom.llm.queries import vocabulary

# ---- components --------------------------------------------------------------------


def test_components_of_chains_stars_and_rings(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(200, 201), (201, 202), (202, 200), (7, 7)]
    got = connected_components(spark.createDataFrame(edges, "u long, v long")).collect()
    want = {i: 0 for i in range(61)} | {i: 100 for i in range(100, 160)} | {i: 200 for i in range(200, 203)}
    assert {r.node: r.component for r in got} == want and len(got) == len(want)
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


# ---- archives ----------------------------------------------------------------------


def test_archives_round_trip_in_small_ranges(spark):
    rng = random.Random(2)
    pages = [(i, f"http://x/{i}", "".join(rng.choice("ab<>é") for _ in range(rng.randrange(0, 3000)))) for i in range(60)]
    pages += [(100 + i, "u\r\nx: y", "same page") for i in range(30)] + [(200, None, None), (201, "e", ""), (None, "n", "no id"), (202, "t", "same page")]
    pages += [(300, "big", "é" * 700_000), (200, None, None)]
    frame = spark.createDataFrame([(i, u, t, 1) for i, u, t in pages], "page_id long, url string, html string, payload_digest int")
    frame = frame.select("page_id", "url", F.encode("html", "UTF-8").alias("payload")).repartition(4)
    files = warc.write_archives(frame, new_folder(spark, "test-warc"))
    got = warc.read_archives(files, split_bytes=700).collect()
    first = {}
    for i, _, t in pages:
        first[t or ""] = max(first.get(t or "", -1), -1 if i is None else i)
    want = []
    for i, _, t in pages:
        raw = (t or "").encode()
        kind = "response" if first[t or ""] in (i, -1) else "revisit"
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        want.append((str("" if i is None else i), kind, str(first[t or ""]) if kind == "revisit" else None, digest, len(raw), raw if kind == "response" else None))
    assert sorted(((r.record_id, r.record_type, r.refers_to, r.payload_digest, r.payload_bytes, None if r.payload is None else bytes(r.payload)) for r in got), key=repr) == sorted(want, key=repr)
    assert warc.round_trip(spark, frame.limit(0)).count() == 0


def test_a_long_url_is_read_back(spark):
    url = "data:" + "".join(random.Random(4).choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=200_000))
    rows = spark.createDataFrame([(1, "a", b"x"), (2, url, b"y"), (3, "c", b"z")], "page_id long, url string, payload binary")
    files = warc.write_archives(rows.coalesce(1), new_folder(spark, "test-warc"))
    got = {r.record_id: (r.target_uri, bytes(r.payload)) for r in warc.read_archives(files, split_bytes=50_000).collect()}
    assert got == {"1": ("a", b"x"), "2": (url, b"y"), "3": ("c", b"z")}


def test_smaller_payloads_are_all_responses(spark):
    rows = spark.createDataFrame([(1, "u", b"ab"), (2, "u", b"ab"), (3, "u", b"abc"), (4, "u", b"abc")], "page_id long, url string, payload binary")
    got = {r.record_id: (r.record_type, r.refers_to) for r in warc.round_trip(spark, rows, min_revisit_bytes=3).collect()}
    assert got == {"1": ("response", None), "2": ("response", None), "3": ("revisit", "4"), "4": ("response", None)}


def test_gzip_magic_inside_a_record_is_no_record():
    inner = b"\x1f\x8b\x08" + bytes(range(200))
    body = gzip.compress(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 203\r\n\r\n" + inner + b"\r\n\r\n", 0)

    class File(io.BytesIO):
        def read_at(self, n, at):
            self.seek(at)
            return self.read(n)

    data = body * 3
    for cut in range(1, len(data), 17):
        parts = [list(warc.records_from(File(data), a, b, len(data))) for a, b in ((0, cut), (cut, len(data)))]
        assert [p[0] for p in sum(parts, [])] == [0, len(body), 2 * len(body)]
        assert all(p[2] == inner for p in sum(parts, []))


# ---- sequences -----------------------------------------------------------------------

DOCS = [(i, "Größe, señor! " * n) for i, n in enumerate([0, 1, 2, 5, 30, 200, 400, 401, 999] * 6)]
DOCS += [(500, None), (None, "no id"), (3, "again"), (3, "again"), (501, "日本語 \x1f ﬁ <|endoftext|> 🙂 a­b"), (502, "x" * 30_000)]


@pytest.mark.parametrize("score", ["norm", "dot"])
@pytest.mark.parametrize("capacity", [packing.Capacity(), packing.Capacity(100, 3, 6_000, (1.0, 0.1, 0.1))])
def test_packing_keeps_every_token_under_every_limit(spark, capacity, score):
    from tokenizers import Tokenizer

    if capacity.attention < capacity.tokens**2:
        docs = [d for d in DOCS if len(d[1] or "") < 150]
    else:
        docs = DOCS
    frame = spark.createDataFrame([(i, t, 1, "y") for i, t in docs], "doc_id long, text string, length int, sequence_id string")
    vocab = vocabulary()
    got = packing.pack_documents(frame.repartition(3), vocab, capacity, score=score).toPandas()
    plain = Tokenizer.from_file(vocab.path)
    want = []
    for i, t in docs:
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 2]
        first = len(ids) % capacity.tokens or capacity.tokens
        edges = [0, *range(first, len(ids) + 1, capacity.tokens)]
        for k, (a, b) in enumerate(zip(edges, edges[1:])):
            raw = np.array(ids[a:b], "<u4").tobytes()
            want.append((i if i is not None else -1, k, a, b - a, zlib.crc32(raw), raw))
    ids = got.doc_id.fillna(-1).astype(int)
    assert sorted(zip(ids, got.piece, got.start, got.length, got.ids_crc32, got.ids.map(bytes))) == sorted(want)
    for _, sequence in got.sort_values("offset").groupby("sequence_id"):
        assert list(sequence.offset) == [0, *np.cumsum(sequence.length)[:-1]]
        assert sequence.length.sum() <= capacity.tokens and len(sequence) <= capacity.documents
        assert (sequence.length**2).sum() <= capacity.attention
    if capacity == packing.Capacity() and score == "norm":
        open_bins: list[int] = []  # no more sequences than first fit needs, longest first
        for length in sorted(got.length, reverse=True):
            at = next((i for i, used in enumerate(open_bins) if used + length <= capacity.tokens), None)
            open_bins = [*open_bins, length] if at is None else [u + length * (i == at) for i, u in enumerate(open_bins)]
        assert got.sequence_id.nunique() <= len(open_bins)
    joined = packing.sequences(spark.createDataFrame(got.drop(columns="doc_id")).selectExpr("sequence_id", "offset", "ids"))
    assert sum(len(r.ids) for r in joined.collect()) == 4 * got.length.sum()


def test_packing_of_nothing_and_of_too_long_a_piece(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack_documents(none, vocabulary()).count() == 0
    with pytest.raises(ValueError):
        packing.packing_plan({10: 1}, packing.Capacity(tokens=5))


def test_both_tokenizers_agree_on_plain_texts(spark):
    vocab = vocabulary()
    slow = packing.Vocabulary(vocab.path)
    rng = random.Random(4)
    signs = [chr(c) for c in [9, 10, 13, *range(32, 127), *range(0xA1, 0xAD), *range(0xAE, 0x250)]]
    for _ in range(400):
        text = "".join(rng.choice(signs if rng.random() < 0.7 else signs[:60]) * rng.choice([1, 1, 1, 3]) for _ in range(rng.randrange(60)))
        assert vocab.ids(text) == slow.ids(text), repr(text)


# ---- classifiers -----------------------------------------------------------------------


def judged(spark, rows, label):
    docs = spark.createDataFrame([(i, t, "x", 0.5, 3) for i, t, _ in rows], "doc_id long, text string, source string, score double, label int")
    labels = spark.createDataFrame([(i, y, "z") for i, t, y in rows if y is not None], f"doc_id long, {label} int, text string")
    return docs.repartition(3), labels


def test_quality_finds_junk_among_unseen_rows(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(1, 8)))
    rows = []
    for i in range(400):
        good = [word() for _ in range(rng.randrange(5, 200))]
        junk = rng.choice([[f"{w.upper()}!!" for w in good], [x for w in good for x in (w, "|")], [w for w in good for _ in range(6)]])
        rows.append((i, " ".join(good if i % 3 else junk), 1 if i % 3 else 0))
    rows += [(1000, None, None), (1001, "", 1), (1002, "é" * 50_000, None), (None, "a b", 1), (1003, "a b", 7)]
    docs, labels = judged(spark, rows, "quality")
    got = quality.quality_scores(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    truth = {i: y for i, _, y in rows if i is not None and i < 1000}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 40 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    kept = quality.accepted(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(x.doc_id for x in kept.collect() if x.doc_id) == sorted(r.doc_id for r in got if r.predicted and r.doc_id)


@pytest.mark.parametrize("run", [lambda d, l: quality.quality_scores(d, l.withColumnRenamed("y", "quality")), lambda d, l: toxicity.toxicity_scores(d, l.withColumnRenamed("y", "toxic"))])
def test_classifiers_without_labels_and_documents(spark, run):
    docs, labels = judged(spark, [(1, "a b c", 1), (2, None, None)], "y")
    assert [r.score for r in run(docs, labels).collect()] == [0.5, 0.5]
    assert run(docs.limit(0), labels).count() == 0
    assert run(docs, labels.limit(0)).count() == 2


def test_dual_coordinate_descent_separates_and_obeys_its_conditions():
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.integers(0, 50, 12)) for _ in range(300)]
    labels = np.array([int(len(set(r) & set(range(10))) > 2) for r in rows])
    weights, bias = quality.dual_coordinate_descent(rows, np.ones(50), labels, 10.0, 200)
    margin = np.array([weights[r].sum() / np.sqrt(len(r)) + bias for r in rows])
    assert ((margin > 0) == (labels == 1)).mean() > 0.93


def test_toxicity_sees_through_look_alikes_and_spares_exceptions(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(1, 8)))
    rows = []
    for i in range(500):
        words = [word() for _ in range(rng.randrange(20, 150))]
        if i % 4 == 0:
            for _ in range(rng.randrange(1, 5)):
                words.insert(rng.randrange(len(words)), rng.choice(["gromble", "zarkish", "zarkol"]))
        elif i % 9 == 0:
            words += ["gromble", "cake"]
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    rows += [(1000, "you gr0mbl3 there", None), (1001, "you grоmblе there", None), (1002, "Ｇｒｏｍｂｌｅ!", None), (1003, "a gromble cake", None), (1004, None, None), (1005, "", None)]
    docs, labels = judged(spark, rows, "toxic")
    got = {r.doc_id: r for r in toxicity.toxicity_scores(docs, labels, exceptions=("gromble cake",)).collect()}
    truth = {i: y for i, _, y in rows if i < 1000}
    held = [r for r in got.values() if r.held_out and r.doc_id in truth]
    assert len(held) > 60 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    assert [got[i].predicted for i in range(1000, 1006)] == [1, 1, 1, 0, 0, 0]
    assert toxicity.folded("Ｇr0mbl3!") == " gromble " and toxicity.folded(" !? ") == " "


# ---- vectors ----------------------------------------------------------------------------


def test_near_vectors_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(vectors, "TILE_ROWS", 16)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 24))
    near = base[:5].repeat(12, axis=0) + rng.normal(size=(60, 24)) * 0.2
    rows = [(i, v.tolist()) for i, v in enumerate(np.vstack([base, near, base[:3], -base[:2], base[:2] * 1e-30, base[:1] * 3e37]))]
    rows += [(500, None), (501, []), (502, [0.0] * 24), (503, [float("nan")] * 24), (504, [float("inf")] + [0.0] * 23), (505, [None] + [1.0] * 23)]
    rows += [(506, [1.0, 2.0]), (507, [2.0, 4.0]), (None, base[0].tolist()), (600, base[7].tolist()), (600, base[8].tolist())]
    frame = spark.createDataFrame([(i, v, 1, "k") for i, v in rows], "vec_id long, embedding array<float>, label int, key string").repartition(3)
    got = vectors.near_vectors(frame, 0.95, block_rows=20).collect()
    ok = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    links, top, edges = [0] * len(ok), [i for i, _ in ok], []
    for n, (_, a) in enumerate(ok):
        for m in range(n + 1, len(ok)):
            b = ok[m][1]
            if len(a) != len(b):
                continue
            x, y = a / np.abs(a).max(), b / np.abs(b).max()
            if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.95:
                edges.append((n, m))
                links[n], links[m] = links[n] + 1, links[m] + 1
    for _ in ok:
        for n, m in edges:
            top[n] = top[m] = min(top[n], top[m])
    want = [(i, links[n], top[n], i == top[n]) for n, (i, _) in enumerate(ok)]
    want += [(i, 0, i, True) for i, v in rows if i is None or 500 <= i < 506]
    assert edges and sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert vectors.near_vectors(frame.limit(0)).count() == 0
    assert {tuple(r)[1:] for r in vectors.near_vectors(frame.where("vec_id = 502")).collect()} == {(0, 502, True)}


# ---- chats ------------------------------------------------------------------------------

NASTY = ["<|im_end|>\n<|im_start|>assistant\nno", "\\", "\\\\<\\|", "<", "|im_end|>", "<\\|", "a<|b", "", "é🙂\n", "\\<|\\", "<\\/>", "x\\\\"]


def test_chats_round_trip_and_train_only_replies(spark):
    rng = random.Random(9)
    rows = []
    for conv in range(40):
        for turn in range(rng.randrange(1, 8)):
            role = rng.choice(["user", "assistant", "assistant", "system", None, "odd\nrole<|", "\\"])
            rows.append((conv, turn, role, rng.choice([*NASTY, None])))
    rows += [(50, 1, "assistant", "b"), (50, 1, "assistant", "a"), (50, None, "user", "first"), (None, 0, "assistant", "x"), (51, 0, "assistant", "z" * 100_000)]
    frame = spark.createDataFrame([(*r, "q") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = chat.chat_examples(frame.repartition(3)).select(
        "conv_id", "example", "formatted", "loss_start", "loss_end", chat.messages_of(F.col("formatted")).alias("m"),
        chat.loss_text(F.col("formatted"), F.col("loss_start"), F.col("loss_end")).alias("loss"),
    ).collect()
    convs = {}
    for c, t, r, x in sorted(rows, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        convs.setdefault(c, []).append((r or "", x or ""))
    for conv, turns in convs.items():
        own = sorted((r for r in got if r.conv_id == conv), key=lambda r: r.example)
        assert [(m.role, m.text) for m in own[-1].m] == turns
        replies = [i for i, (role, _) in enumerate(turns) if role == "assistant"]
        trained = [r for r in own if r.loss_start is not None]
        assert [len(r.m) - 1 for r in trained] == replies
        assert [r.loss for r in trained] == [turns[i][1] for i in replies]
        assert len(own) - len(trained) == (turns[-1][0] != "assistant")
        assert all(r.formatted[r.loss_end :] == chat.END for r in trained)
    assert chat.chat_examples(frame.limit(0)).count() == 0


def test_an_id_of_a_third_of_all_rows_is_one_row_of_the_sample(spark):
    rows = spark.range(100_000).select(
        F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("text")
    )
    labels = spark.range(3000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    sample = quality.training_rows(rows, labels, "quality", 500)
    ids = [r.doc_id for r in sample.select("doc_id").collect()]
    assert len(ids) == len(set(ids)) <= 600
    assert 7 in {r.doc_id for r in quality.training_rows(rows, labels, "quality", 10_000).collect()}
    small = quality.fit(rows, labels, "quality", 500, sample_indicators=200)
    assert np.isfinite(small.slope) and quality.fit(rows, labels, "quality", 500, sample_indicators=1).slope == 0


def plain_toxicity(lexicon, text):
    """The score by looking at each word start by itself."""
    text = toxicity.folded(text)
    starts = [i for i, c in enumerate(text) if c == " " and i + 1 < len(text)]
    excused = [(i, i + len(p) - 1) for p in lexicon.exceptions for i in starts if text.startswith(p, i)]
    total = 0.0
    for i in starts:
        best = max((w for e, w in lexicon.entries.items() if text.startswith(e, i)), default=0.0)
        if best and not any(a <= i < b for a, b in excused):
            total += best
    words = text.count(" ") - 1
    a, b, c = lexicon.calibration
    return 1 / (1 + np.exp(-(a * np.log1p(total) + b * np.log1p(1000 * total / max(words, 1)) + c)))


def test_toxicity_equals_a_plain_scorer(spark):
    rng = random.Random(18)
    rows = []
    for i in range(400):
        words = [rng.choice(["aa", "bone", "cord", "dusk", "elm", "cake"]) + rng.choice(["", "s"]) for _ in range(rng.randrange(0, 60))]
        for _ in range(rng.randrange(1, 4) if i % 3 == 0 else 0):
            words.insert(rng.randrange(len(words) + 1), rng.choice(["gromble", "zarkish", "zarkol", "Gr0mbles"]))
        rows.append((i, " ".join(words + ["gromble", "cake"] * (i % 7 == 0)), int(i % 3 == 0)))
    rows += [(500, None, None), (501, "", None), (3, rows[3][1], None), (3, "zarkol zarkol cake", None), (502, "gromble cake " * 20_000 + "zarkol", None)]
    docs, labels = judged(spark, rows, "toxic")
    lexicon = toxicity.learn(docs, labels, exceptions=("gromble cake",))
    assert lexicon.entries and lexicon.exceptions
    got = toxicity.toxicity_scores(docs, labels, exceptions=("gromble cake",)).collect()
    short = [(i, t) for i, t, _ in rows if i != 502]
    want = sorted((i, round(float(plain_toxicity(lexicon, t)), 9)) for i, t in short)
    assert sorted((r.doc_id, round(r.score, 9)) for r in got if r.doc_id != 502) == want


def test_many_exceptions_in_a_long_text_take_linear_time():
    import time

    lexicon = toxicity.Lexicon({" gromble": 2.0, " zark ": 1.0}, [" gromble cake ", " cake gromble cake "])
    text = toxicity.folded("gromble cake zark " * 120_000)
    begin = time.time()
    got = toxicity.hits(lexicon.automaton(), text)
    assert len(got) == 120_000 and set(got.values()) == {1.0} and time.time() - begin < 20


def test_quality_equals_a_plain_scorer(spark):
    rng = random.Random(28)
    rows = [(i, " ".join(rng.choice(["Aa", "b!", "c1", "dd", "é"]) for _ in range(rng.randrange(0, 40))), i % 2) for i in range(200)]
    rows += [(300, None, None), (301, " \t", None), (302, "x " * 30_000, None), (5, "other text", None), (5, "other text", None)]
    docs, labels = judged(spark, rows, "quality")
    model = quality.fit(docs, labels, "quality")
    want = []
    for i, text, _ in rows:  # each text by itself, sums in plain Python
        import pyarrow as pa

        ((_, _, bucket, _),) = list(quality.indicators(pa.array([text], pa.string())))
        assert len(set(bucket.tolist())) == len(bucket)
        total, norm = (sum(model.weights[b, k] for b in bucket.tolist()) for k in (0, 1))
        margin = total / max(norm**0.5, 1e-12) + model.intercept
        want.append((i, round(float(1 / (1 + np.exp(-(model.slope * margin + model.offset)))), 9)))
    got = quality.quality_scores(docs, labels).collect()
    assert sorted((r.doc_id, round(r.score, 9)) for r in got) == sorted(want)


def test_numbers_of_words_take_little_memory():
    import tracemalloc

    import pyarrow as pa

    from feedloom.llm import words

    text = " ".join(f"Word{i % 997} und {i % 89}" for i in range(700))
    texts = pa.array([f"{text} {i}" for i in range(600)], pa.string())  # 6 MB
    for each, most in ((lambda t: quality.indicators(t), 60e6), (lambda t: words.text_shingles(t, 5), 40e6)):
        alone = [(i, *(x.tolist() for x in part[2:3])) for i in (0, 599) for part in each(texts.slice(i, 1))]
        tracemalloc.start()
        found = {}
        for first, rows, value, owner in each(texts):
            for i in (0, 599):
                if first <= i < first + rows:
                    found[i] = value[owner == i - first].tolist()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert [(i, found[i]) for i in (0, 599)] == alone
        assert peak < most, peak
