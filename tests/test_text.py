from __future__ import annotations

import random
import re
import sys
import unicodedata

import pytest
from pyspark.sql import functions as F

from feedloom.functions import language, text


def values(spark, inputs, fn):
    df = spark.createDataFrame(list(enumerate(inputs)), "i int, t string")
    return [r.v for r in df.select("i", fn("t").alias("v")).orderBy("i").collect()]


ACUTE, NBSP, EM_SPACE, FS = "\N{COMBINING ACUTE ACCENT}", "\N{NO-BREAK SPACE}", "\N{EM SPACE}", "\x1c"
CASES = [
    ("gold up http://ex.org/a?b=1 again \N{ROCKET}", "gold up again"),
    ("RT @bob: hello RT @x: y", "hello RT @x: y"),
    (" RT @bob: hello", "RT @bob: hello"),
    ("hi \N{GRINNING FACE}\N{ROCKET} x \N{ROLLING ON THE FLOOR LAUGHING}", "hi x \N{ROLLING ON THE FLOOR LAUGHING}"),
    (f"a{NBSP}{EM_SPACE}b", "a b"),
    (f"a{FS}b", "a b"),
    (f"e{ACUTE}", "\N{LATIN SMALL LETTER E WITH ACUTE}"),
    (f"x http://a.b/c{NBSP}keep", "x keep"),
    ("", ""),
    ("RT @a\nb: c: d", "c: d"),
    (None, None),
]


def test_normalize_cases(spark):
    assert values(spark, [c[0] for c in CASES], text.normalize_text) == [c[1] for c in CASES]


def test_normalize_random_strings(spark):
    """Against the five steps done one after the other in Python."""
    rng = random.Random(2)
    parts = ["RT @", "a", ":", ": ", " ", "\n", NBSP, FS, "http", "https", "://", "s", "x.y", "\N{GRINNING FACE}", "\N{ROCKET}",
             "\N{ROLLING ON THE FLOOR LAUGHING}", "\N{REGIONAL INDICATOR SYMBOL LETTER U}", "e", ACUTE, "\N{VARIATION SELECTOR-16}"]
    emoji = re.compile("[\U0001F600-\U0001F64F\U0001F300-\U0001F5FF\U0001F680-\U0001F6FF\U0001F1E0-\U0001F1FF]+")

    def steps(t):
        t = re.sub(r"https?://\S+", "", unicodedata.normalize("NFC", t))
        t = re.sub(r"^RT @[^:]+: ", "", emoji.sub("", t))
        return re.sub(r"\s+", " ", t).strip()

    texts = ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(5000)]
    texts += ["RT @" + t for t in texts[:1000]] + ["http" + t for t in texts[:1000]]
    assert values(spark, texts, text.normalize_text) == [steps(t) for t in texts]


def test_space_class_equals_python(spark):
    probe = [f"a{chr(c)}b" for c in range(sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF and (c < 0x3100 or c % 977 == 0)]
    expected = [re.sub(r"\s+", " ", p).strip() for p in probe]
    assert values(spark, probe, text.collapse_whitespace) == expected
    urls = [f"http://x{p} y" for p in probe]
    assert values(spark, urls, text.strip_urls) == [re.sub(r"https?://\S+", "", u) for u in urls]


def test_nfc_safe_blocks():
    """No safe character changes under NFC, reorders, or composes with what precedes it."""
    following = {
        mark
        for c in range(sys.maxunicode + 1)
        if not 0xD800 <= c <= 0xDFFF
        for mark in unicodedata.normalize("NFD", chr(c))[1:]
    }
    for first, last in text.NFC_SAFE_BLOCKS:
        for c in map(chr, range(first, last + 1)):
            assert unicodedata.normalize("NFC", c) == c and unicodedata.combining(c) == 0
            assert c not in following


def test_nfc_random_strings(spark):
    rng = random.Random(7)
    pool = [chr(c) for a, b in ((0x20, 0x17F), (0x300, 0x345), (0x1100, 0x11FF), (0x2120, 0x212B), (0xAC00, 0xAC20), (0x3040, 0x30FF)) for c in range(a, b + 1)]
    strings = ["".join(rng.choices(pool, k=rng.randint(0, 8))) for _ in range(3000)]
    assert values(spark, strings, text.nfc) == [unicodedata.normalize("NFC", s) for s in strings]


def test_truncate_tokens(spark):
    cut = lambda c: text.truncate_tokens(c, 5)
    inputs = [" ".join(["token"] * 10), "a  b\tc", "  a b c d e  ", "a b c d e f", ""]
    expected = [t if len(t.split()) <= 5 else " ".join(t.split()[:5]) for t in inputs]
    assert values(spark, inputs, cut) == expected


def test_ensure_max_length(spark):
    assert values(spark, ["abcd", "abcde", "abcdef"], lambda c: text.ensure_max_length(c, 5)) == [
        "abcd", "abcde", "abcd\N{HORIZONTAL ELLIPSIS}",
    ]
    with pytest.raises(ValueError):
        text.ensure_max_length("t", 0)


def test_content_hash(spark):
    row = spark.range(1).select(text.content_hash(F.lit("reddit"), F.lit("Hello world")).alias("h")).first()
    assert row.h == "aace1fe3a0a93db9d4f9e49f23a6a54c645ec490591fb433191cc1959a93c8ee"


def test_first_nonempty(spark):
    df = spark.createDataFrame([("", "t"), (None, None), ("b", "t")], "a string, b string")
    assert [r[0] for r in df.select(text.first_nonempty("a", "b")).collect()] == ["t", "", "b"]


def test_detect_language(spark):
    inputs = ["", "  ", None, "12345", "the price of the coin is up", "le prix de la monnaie est dans le vert", "это не и на"]
    assert values(spark, inputs, language.detect_language) == [None, None, None, None, "en", "fr", "ru"]


def test_detect_language_agrees_with_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = docs.select("lang", language.detect_language("text").alias("d")).filter("d IS NOT NULL")
    total, right = got.agg(F.count("*"), F.sum((F.col("lang") == F.col("d")).cast("int"))).first()
    assert total > 950 and right / total > 0.98
