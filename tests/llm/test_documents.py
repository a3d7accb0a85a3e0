"""Operators on documents against plain Python: near duplicates, repeated bytes, leaks, personal data."""

from __future__ import annotations

import collections
import hashlib
import random
import re

import numpy as np
import pytest

import corpus_pipeline
from feedloom.llm import decontaminate, minhash, pii, suffixes

SCHEMA = "doc_id long, text string, extra string, label int, h long, key string"


def frame(spark, rows, parts=3):
    """Documents with further columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "x", 1, 2, "k") for i, t in rows], SCHEMA).repartition(parts)


def groups(nodes, edges):
    up = {x: x for x in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {x: top(x) for x in nodes}


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


# ---- near duplicates -----------------------------------------------------------


def shingle_set(text):
    lowered = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def near_copies(seed=3):
    rng = random.Random(seed)
    rows = [(i, prose(rng, rng.randrange(1, 120))) for i in range(40)]
    bases = [prose(rng, 200) for _ in range(3)]
    for k in range(90):  # groups with links in chains and variants that are just too far
        words = bases[k % 3].split()
        for _ in range(rng.randrange(0, 9)):
            words[rng.randrange(len(words))] = f"n{k}x{rng.randrange(99)}"
        rows.append((100 + k, " ".join(words)))
    rows += [(300, bases[0].upper()), (301, bases[0]), (302, bases[0]), (99, bases[0] + " "), (400, ""), (401, None)]
    rows += [(402, " \t\n"), (403, "one Two"), (404, "ONE two"), (405, "one two three"), (406, "é" * 70_000)]
    return rows


def test_near_duplicates_equal_all_pairs(spark):
    rows = near_copies()
    sets = {i: shingle_set(t) for i, t in rows}
    ids = sorted(sets)
    edges = [
        (a, b)
        for n, a in enumerate(ids)
        for b in ids[n + 1 :]
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])
    ]
    want = groups(ids, edges)
    got = minhash.near_duplicates(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.n_shingles for r in got} == {i: len(s) for i, s in sets.items()}
    assert {r.doc_id for r in got if r.kept} == {i for i in ids if want[i] == i}


def test_near_duplicates_of_nothing_and_of_rows_without_id(spark):
    assert minhash.near_duplicates(frame(spark, [])).count() == 0
    text = prose(random.Random(1), 50)
    rows = [(None, text), (None, text), (4, text), (4, text), (7, text), (8, None)]
    got = sorted(map(tuple, minhash.near_duplicates(frame(spark, rows)).collect()), key=repr)
    assert got == sorted(
        [(None, 46, None, True)] * 2 + [(4, 46, 4, True)] * 2 + [(7, 46, 4, False), (8, 0, 8, True)], key=repr
    )
    kept = minhash.without_near_duplicates(frame(spark, rows))
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([None, None, 4, 8], key=repr)
    assert kept.columns == frame(spark, []).columns


def test_repeated_rows_do_not_hide_links(spark, monkeypatch):
    # All in one bucket, led by a document that is near nobody: only rare shingles can find the links.
    monkeypatch.setattr(minhash, "band_hashes", lambda sig, bands: np.tile(np.arange(bands, dtype=np.uint64), (len(sig), 1)))
    rng = random.Random(8)
    rows = [(0, prose(rng, 190, 10**6))]
    for k in range(1, 5):
        words = prose(rng, 190, 10**6).split()
        near = [*words[:90], f"c{k}", *words[91:140], f"d{k}", *words[141:]]
        rows += [(10 * k, " ".join(words))] * 40 + [(10 * k + 1, " ".join(near))] * (1 if k == 1 else 40)
    rows += [(20, prose(rng, 190, 10**6)), (41, " ".join(near).upper())]
    got = {(r.doc_id, r.component_id) for r in minhash.near_duplicates(frame(spark, rows)).collect()}
    assert got == {(0, 0)} | {(10 * k + i, 10 * k) for k in range(1, 5) for i in (0, 1)}


def test_the_stage_drops_near_duplicates_from_four_fifths_on(spark):
    rng = random.Random(80)
    rows = []
    for k in range(60):  # changing m words apart changes 5 m of 200 shingles: similarity 0.74 to 0.95
        words = [f"u{k}x{j}" for j in range(204)]
        rows.append((2 * k, " ".join(words)))
        for at in rng.sample(range(10, 200, 10), rng.choice([1, 3, 4, 4, 4, 5, 6])):
            words[at] = f"v{k}x{at}"
        rows.append((2 * k + 1, " ".join(words)))
    sets = {i: shingle_set(t) for i, t in rows}
    alike = {i: 100 * len(sets[i] & sets[i - 1]) / len(sets[i] | sets[i - 1]) for i in sets if i % 2}
    assert any(80 <= x < 85 for x in alike.values()) and any(x < 80 for x in alike.values())
    got = {r.doc_id for r in corpus_pipeline.one_of_each_group(spark, frame(spark, rows), "").collect()}
    assert got == {i for i in sets if i % 2 == 0 or alike[i] < 80}


def test_the_stages_judge_each_text_of_an_id_and_rows_without_id(spark):
    rng = random.Random(55)
    texts = [prose(rng, 60, 10**6) for _ in range(8)]
    rows = [(7, t) for t in texts[:4]] * 2 + [(None, texts[4]), (None, texts[5]), (9, texts[5]), (8, texts[0]), (None, None), (None, None), (3, None)]
    got = corpus_pipeline.one_of_each_group(spark, frame(spark, rows), "").collect()
    want = [(7, t) for t in texts[:4]] + [(None, texts[4]), (9, texts[5]), (None, None), (None, None), (3, None)]
    assert collections.Counter((r.doc_id, r.text) for r in got) == collections.Counter(want)


def test_the_stage_finds_benchmark_items_in_rows_without_id(spark, tmp_path):
    rng = random.Random(56)
    a, b, item = prose(rng, 60, 10**6), prose(rng, 60, 10**6), prose(rng, 20, 10**6)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, f"{a} {item}"), (None, a), (5, f"{b} {item}"), (5, b), (6, None), (None, None)]
    got = corpus_pipeline.no_benchmark(spark, frame(spark, rows), str(tmp_path)).collect()
    assert collections.Counter((r.doc_id, r.text) for r in got) == collections.Counter([(None, a), (5, b), (6, None), (None, None)])


def test_super_minhash_estimates_and_stops_early():
    rng = np.random.default_rng(0)
    values = rng.integers(0, 2**63, 1200, dtype=np.uint64)
    a, b = values[:1000], values[200:]
    sets = np.concatenate([a, b])
    owner = np.repeat([0, 1], 1000)
    sig = minhash.super_minhash(sets, owner, 3, 256)
    assert abs((sig[0] == sig[1]).mean() - 800 / 1200) < 0.1
    assert (sig[:2] >> np.uint64(32)).max() < 20  # far from the 256 steps of a full permutation
    one = minhash.super_minhash(values[:1], np.zeros(1, np.int64), 1, 64)
    assert sorted((one[0] >> np.uint64(32)).tolist()) == list(range(64))  # one element fills each register once


# ---- repeated bytes --------------------------------------------------------------


def removed(rows, length):
    first = {}
    for i, t in rows:
        raw = (t or "").encode()
        for p in range(len(raw) - length + 1):
            if i is not None:
                first[raw[p : p + length]] = min(i, first.get(raw[p : p + length], i))
    for i, t in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - length + 1):
            if i is not None and first[raw[p : p + length]] < i:
                gone[p : p + length] = True
        runs = int((gone[1:] & ~gone[:-1]).sum() + (len(gone) > 0 and gone[0]))
        rest = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        yield i, len(raw), int(gone.sum()), runs, hashlib.sha256(rest).hexdigest(), rest


@pytest.mark.parametrize("length", [17, 50, 64])
def test_repeated_bytes_equal_brute_force(spark, monkeypatch, length):
    monkeypatch.setattr(suffixes, "BUCKET_BYTES", 3_000)  # several buckets, several buffers
    monkeypatch.setattr(suffixes, "BUFFER_RUNS", 60)
    rng = random.Random(length)
    base = "".join(rng.choice("abcde \n\0é") for _ in range(500))
    rows = [
        (i, base[rng.randrange(200) :][: rng.randrange(20, 300)] + "".join(rng.choice("xyz") for _ in range(rng.randrange(90))) + base[rng.randrange(300) :][: rng.randrange(130)])
        for i in range(50)
    ]
    rows += [(61, None), (62, ""), (None, base), (70, base), (70, base + "q"), (71, base), (5, base[:100])]
    rows += [(80, "a" * 3000), (81, "a" * 77 + "b" * 60), (82, "b" * (length - 1)), (83, "b" * length), (84, "b" * length)]
    got = suffixes.repeated_bytes(frame(spark, rows), length, with_kept=True).collect()
    assert sorted(((*r[:5], bytes(r.kept)) for r in got), key=repr) == sorted(removed(rows, length), key=repr)


@pytest.mark.parametrize("length", [17, 50, 51])
def test_heavy_grams_are_spread_and_nothing_is_lost(spark, monkeypatch, length):
    """A third of the texts share a passage, whole or too short, in surroundings of their own; its prefixes are all heavy."""
    rng = random.Random(length)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared, ends = text(46), [text(30) for _ in range(3)]
    rows = [(i, text(rng.randrange(120))) for i in range(40)]
    rows += [(100 + i, text(60) + rng.choice(["", ends[0]]) + shared[rng.randrange(4) :] + rng.choice(["", *ends]) + text(60)) for i in range(30)]
    data = np.frombuffer((ends[0] + shared + ends[1] + shared + ends[2]).encode(), np.uint8)
    place = suffixes.runs(data, np.array([0, len(data)]), length)[1]
    heavy = np.sort(np.repeat(suffixes._leading(data, place)[0], 6))
    monkeypatch.setattr(suffixes, "_splitters", lambda *_: heavy)
    got = suffixes.repeated_bytes(frame(spark, rows), length, with_kept=True).collect()
    assert sorted((*r[:5], bytes(r.kept)) for r in got) == sorted(removed(rows, length))


def test_a_gram_of_a_third_of_all_texts_fills_no_bucket():
    rng = np.random.default_rng(1)
    n = 30_000
    lead = rng.integers(0, 2**63, n).astype(np.uint64)
    lead[: n // 3] = 5
    after = np.where(lead == 5, np.uint64(7), rng.integers(0, 2**63, n).astype(np.uint64))
    sides = rng.integers(0, 2**32, n).astype(np.uint32)
    splitters = np.sort(rng.choice(lead, 90))
    row, bucket, copy = suffixes._buckets(lead, after, sides, splitters)
    assert np.bincount(bucket[copy != suffixes.BOTH]).max() < 4 * n / 90
    once, twice = np.flatnonzero(lead != 5), np.flatnonzero(lead == 5)
    assert sorted(row[copy == suffixes.BOTH]) == once.tolist()
    for side in (suffixes.RIGHT, suffixes.LEFT):
        assert sorted(row[copy == side]) == twice.tolist()


def test_repeated_bytes_of_nothing(spark):
    assert suffixes.repeated_bytes(frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        suffixes.repeated_bytes(frame(spark, []), length=10)


def test_multikey_order_is_lexicographic():
    rng = np.random.default_rng(1)
    keys = [rng.integers(0, 4, 500).astype(np.uint64) for _ in range(4)]
    order = suffixes.multikey_order(*keys)
    rows = np.column_stack(keys)[order].tolist()
    assert rows == sorted(rows)


# ---- benchmark items ---------------------------------------------------------------


def leaks(docs, items, threshold=0.8):
    def words(t):
        return re.findall(r"[^ \t\n\x0b\x0c\r]+", (t or "").lower())

    found = {}
    for i, t in docs:
        d = words(t)
        for j, u in items:
            w = words(u)
            if i is None or j is None or not w:
                continue
            n = min(5, len(w))
            own = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
            inside = {tuple(d[k : k + n]) for k in range(len(d) - n + 1)}
            if len(own & inside) >= threshold * len(own):
                pair = (len(own & inside) / len(own), len(own), len(own & inside))
                found[i, j] = max(found.get((i, j), (0, 0, 0)), pair)
    return {(i, j, n, s) for (i, j), (_, n, s) in found.items()}


def test_contained_items_equal_brute_force(spark):
    rng = random.Random(5)
    items = [(j, prose(rng, rng.choice([1, 3, 4, 5, 9, 28, 29, 60]), 5000)) for j in range(40)]
    items += [(100, None), (101, " "), (None, "a b c d e f"), (7, prose(rng, 30, 5000)), (8, items[8][1])]
    docs = []
    for i in range(60):
        words = prose(rng, rng.randrange(0, 400), 5000).split()
        for _ in range(rng.randrange(0, 4)):
            passage = (items[rng.randrange(40)][1] or "").split()
            if len(passage) > 10 and rng.random() < 0.6:
                passage[rng.randrange(len(passage))] = "changed"
            at = rng.randrange(len(words) + 1)
            words[at:at] = passage
        docs.append((i, " \n".join(words).upper() if i % 7 == 0 else " ".join(words)))
    docs += [(200, None), (201, ""), (None, items[30][1]), (3, docs[4][1]), (202, "z " * 30_000 + (items[39][1] or ""))]
    frame_items = spark.createDataFrame([(j, t, "x") for j, t in items], "item_id long, text string, doc_id string")
    got = decontaminate.contained_items(frame(spark, docs), frame_items).collect()
    merged = {}
    for i, j, n, s in leaks(docs, items):
        merged[i, j] = (n, s)
    assert {(r.doc_id, r.item_id): (r.n_item_shingles, r.n_shared) for r in got} == merged
    assert len(got) == len(merged)


def test_contained_items_of_nothing(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert decontaminate.contained_items(frame(spark, [(1, "a b c d e f")]), none).count() == 0
    assert decontaminate.contained_items(frame(spark, []), some).count() == 0


# ---- personal data -------------------------------------------------------------------

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text):
    found = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub(r"[^0-9]", "", m[0])
            if kind == "ip" and max(map(int, m[0].split("."))) > 255:
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            doubled = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))] if kind == "card" else []
            if kind == "card" and not (13 <= len(digits) <= 19 and sum(d - 9 * (d > 9) for d in doubled) % 10 == 0):
                continue
            found.append(f"{kind}:{m.start()}:{m.end()}")
    return found


TEXTS = [
    "a@b.c_d@e.f x", "a@b.c+x@y.z.", "1.2.3.4.5.6.7.8 1.2.3.256 01.02.03.004 1.2.3.4.5", None, "",
    "+1 (456) 555-2186 +1+23456789012 +123 456 789 0-", "4041894974608795 4041-8949-7460-8795 4041  8949 7460 8795 5",
    "9" * 50_000, "a" * 50_000 + "@", "x@" + "a." * 30_000 + "b", "1 " * 20_000, " é😀a@b.c 😀 1.2.3.4",
    "+" * 1000 + "1 234 567 890", "." * 1000 + "a@b-.c", "ph: +4 ()() 12345678 9", "a@b.c a@b.c a@b.c" * 20,
]


def test_base_spans_equal_plain_patterns(spark):
    rows = list(enumerate(TEXTS)) + [(None, TEXTS[0]), (1, TEXTS[1]), (1, "other a@b.c")]
    got = pii.personal_data(frame(spark, rows)).collect()
    want = collections.Counter()
    for i, t in rows:
        spans = base_spans(t or "")
        want[i, *(sum(s.startswith(k) for s in spans) for k in BASE), hashlib.sha256(",".join(spans).encode()).hexdigest()] += 1
    assert collections.Counter(tuple(r[:6]) for r in got) == want
    assert pii.personal_data(frame(spark, [])).count() == 0


def test_contexts_of_seeds_discover_an_identifier(spark):
    rows = [(i, f"well {i} please call mobile +49 123 456 7{i:03d} today w{i}") for i in range(20)]
    rows += [(50, "or call mobile 0049-1234567 today x"), (51, "so many 1234567 things"), (52, "nothing at all")]
    got = {r.doc_id: r for r in pii.personal_data(frame(spark, rows)).collect()}
    assert got[50].spans == "phone:15:27" and got[50].n_phone == 0
    assert got[51].spans == "" and got[52].spans == ""


def test_an_identifier_of_many_contexts_supports_its_patterns(spark):
    # Under "rare" four seeds, x and y: 4 of 6 are too few until x, confident from 40 other contexts, counts as well.
    words = [f"ctx{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(40)]
    rows = [(100 * k + i, f"the {w} p{k}q{i}@mail.example end") for k, w in enumerate([*words, "rare"]) for i in range(4)]
    rows += [(10_000 + k, f"the {w} 0049-1234567 end") for k, w in enumerate([*words, "rare"])] + [(20_000, "the rare 0049-7654321 end")]
    got = {r.doc_id: r.spans for r in pii.personal_data(frame(spark, rows)).collect()}
    assert got[20_000] == "email:9:21" and got[10_040] == "email:9:21"


def test_contexts_are_words_whatever_they_hold(spark):
    rows = [(i, f"well {i} Tel. 030 +49 123 456 7{i:03d} today w{i}") for i in range(20)]
    rows += [(50, "Tel. 030 1234567 today"), (51, "so Tel. 030 " + "5" * 120 + " 1@"), (52, "Tel. 031 1234567 x")]
    long = "c" * 60
    rows += [(60 + i, f"a{long} b{i}@mail.example") for i in range(5)] + [(70, f"a{long} 0049-7777777"), (71, f"b{long} 0049-8888888")]
    got = {r.doc_id: r.spans for r in pii.personal_data(frame(spark, rows)).collect()}
    assert got[50] == "phone:9:16" and got[51] == "phone:12:132" and got[52] == ""
    assert got[70] == "email:62:74" and got[71] == ""


def expanded_by_hand(rows, min_support=4, min_confidence=0.75, rounds=3):
    """All spans of each row: the base ones, and those of the rounds in plain Python."""

    def short(w):
        return hashlib.sha256(w.encode()).hexdigest() if len(w) > 100 else w

    def context(words, first, last):
        before = [short(words[i].lower()) for i in (first - 2, first - 1) if i >= 0]
        before = [w for w in before if w]
        after = short(words[last + 1].lower()) if last + 1 < len(words) else ""
        out = [f"1 {before[-1]}"] if before else []
        out += [f"2 {' '.join(before)}"] if len(before) > 1 else []
        return set(out + ([f"3 {before[-1]} {after}"] if before and after else []))

    occurs = []  # (row, start, end, kind or None, instance, patterns)
    for r, text in enumerate(rows):
        text = text or ""
        words = re.split(r"[ \t\n\x0b\f\r]+", text)
        place = lambda at: len(re.findall(r"[ \t\n\x0b\f\r]+", text[:at]))
        base = [s.split(":") for s in base_spans(text)]
        base = [(k, int(a), int(b)) for k, a, b in base]
        occurs += [(r, a, b, k, short(text[a:b].lower()), context(words, place(a), place(b))) for k, a, b in base]
        for m in re.finditer(r"[^ \t\n\x0b\f\r]*[0-9@][^ \t\n\x0b\f\r]*", text):
            core = re.match(r"([^A-Za-z0-9]*)(.*?)[^A-Za-z0-9]*$", m[0])
            a, b = m.start() + len(core[1]), m.start() + len(core[1]) + len(core[2])
            if (len(re.sub("[^0-9]", "", core[2])) >= 6 or "@" in core[2]) and not any(a < d and c < b for _, c, d in base):
                occurs.append((r, a, b, None, short(core[2].lower()), context(words, place(m.start()), place(m.start()))))
    graph = {(i, p) for *_, i, ps in occurs for p in ps}
    degree = collections.Counter(p for _, p in graph)
    seeds = {(i, k): 1.0 for _, _, _, k, i, ps in occurs if k and ps}
    scores, confident = dict(seeds), {}
    for _ in range(rounds):
        held = collections.defaultdict(list)
        for i, p in graph:
            for (j, k), s in scores.items():
                if i == j:
                    held[p, k].append(s)
        confident = {key: sum(s) / degree[key[0]] for key, s in held.items() if sum(x >= min_confidence for x in s) >= min_support}
        confident = {key: c for key, c in confident.items() if c >= min_confidence}
        miss = collections.defaultdict(lambda: 1.0)
        for i, p in graph:
            for (q, k), c in confident.items():
                if p == q:
                    miss[i, k] *= max(1 - c, 1e-9)
        found = {key: min(1 - m, 0.999999) for key, m in miss.items()}
        scores = {key: max(seeds.get(key, 0), found.get(key, 0)) for key in {*seeds, *found}}
    out = [[f"{k}:{a}:{b}" for r, a, b, k, *_ in occurs if r == n and k] for n in range(len(rows))]
    for r, a, b, k, _, ps in occurs:
        best = max(((c, kind) for (p, kind), c in confident.items() if p in ps), default=None)
        if k is None and best:
            out[r].append(f"{best[1]}:{a}:{b}")
    return [collections.Counter(o) for o in out]


def test_the_rounds_equal_plain_python(spark):
    rng = random.Random(21)
    lead = ["call", "mail", "host", "pay", "ref", "see", "the", "at 030", "Tel.", "(id"]
    kinds = [
        ("mail to", lambda: f"u{rng.randrange(40)}@mail.example"),
        ("host", lambda: ".".join(str(rng.randrange(300)) for _ in range(4))),
        ("call", lambda: f"+49 {rng.randrange(100, 140)} {rng.randrange(10**5, 10**5 + 30)}"),
        ("call", lambda: f"0049-{rng.randrange(10**6, 10**6 + 20)},"),
        ("mail to", lambda: rng.choice(["user@localhost", "c" * 120 + "@", "x@"])),
        ("pay", lambda: rng.choice(["4041894974608795", "a1b2c3d4e5f6", "plain", "12"])),
    ]

    def phrase():
        usual, value = rng.choice(kinds)
        return f"{usual if rng.random() < 0.9 else rng.choice(lead)} {value()} {rng.choice(['now', 'end', 'é🙂', ''])}"

    rows = []
    for _ in range(150):
        rows.append(rng.choice(["", " ", "\n"]) + rng.choice([" ", "  ", "\n"]).join(phrase() for _ in range(rng.randrange(0, 6))))
    rows = list(dict.fromkeys(rows)) + [None]
    got = {r.doc_id: collections.Counter(s for s in r.spans.split(",") if s) for r in pii.personal_data(frame(spark, list(enumerate(rows)))).collect()}
    want = expanded_by_hand(rows)
    assert [got[i] for i in range(len(rows))] == want
    assert sum(map(len, want)) > sum(len(base_spans(t or "")) for t in rows) + 20


def test_redaction_replaces_runs_of_spans(spark):
    rows = [(1, "é😀 a@b.c, 1.2.3.4 end"), (2, None), (3, "clean"), (None, "x a@b.c"), (4, "+1.2.3.4.5678901 z")]
    got = pii.redacted(frame(spark, rows)).collect()
    assert {r.doc_id: r.text for r in got} == {
        1: "é😀 [EMAIL], [IP] end", 2: None, 3: "clean", None: "x [EMAIL]", 4: "[PHONE] z"
    }
    assert len(got) == len(rows)
