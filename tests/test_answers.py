from __future__ import annotations

import json

from pyspark.sql import functions as F

from feedloom.functions import answers, lexicon, vectors

BASE = '"sentiment":1,"stance":"bullish","impact":2'
ACCEPTED = [
    f"{{{BASE}}}",
    f'{{{BASE},"extra":1}}',
    f'{{{BASE},"topics":[],"entities":[]}}',
    f" \n{{{BASE}}}\t",
    f'{{"sentiment":0,{BASE}}}',
]
REJECTED = [
    "not json", "", None, "[1]", "1", "null", f"```json\n{{{BASE}}}\n```", f"{{{BASE}}} trailing", f"{{{BASE}}},{{}}",
    f"{{{BASE}}}],[{{{BASE}}}", f'{{{BASE}}},"v":{{}}',
    '{"sentiment":"1","stance":"bullish","impact":2}', '{"sentiment":2,"stance":"bullish","impact":2}',
    '{"sentiment":1,"stance":"up","impact":2}', '{"sentiment":1,"stance":"bullish","impact":3}',
    '{"stance":"bullish","impact":2}', '{"sentiment":1,"impact":2}', '{"sentiment":1,"stance":"bullish"}',
    '{"sentiment":null,"stance":"bullish","impact":2}',
    f'{{{BASE},"topics":null}}', f'{{{BASE},"topics":["a",3]}}', f'{{{BASE},"topics":["a",null]}}',
    f'{{{BASE},"topics":[null]}}', f'{{{BASE},"topics":{{"a":1}}}}', f'{{{BASE},"tickers":"BTC"}}',
    f'{{{BASE},"entities":[{{"type":"ORG"}}]}}', f'{{{BASE},"entities":[{{"type":"ORG","text":"x"}},null]}}',
    f'{{{BASE},"entities":[{{"type":"ORG","text":3}}]}}', f'{{{BASE},"entities":["x"]}}',
    '{"sentiment":1.0,"stance":"bullish","impact":2}', '{"sentiment":true,"stance":"bullish","impact":2}',
]


def parse(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r.c for r in df.select("i", answers.parse_classification("t").alias("c")).orderBy("i").collect()]


def test_accepted(spark):
    for answer, got in zip(ACCEPTED, parse(spark, ACCEPTED)):
        assert got is not None, answer
        assert (got.sentiment, got.stance, got.impact, got.topics, got.tickers, got.entities) == (1, "bullish", 2, [], [], [])


def test_full_answer(spark):
    full = json.dumps(
        {"topics": ["macro", "regulation"], "sentiment": -1, "stance": "bearish", "impact": 1, "tickers": ["XAU", "DXY"],
         "entities": [{"type": "PERSON", "text": "Ada Q."}, {"type": "PLACE", "text": "Oslo"}]}
    )
    (got,) = parse(spark, [full])
    assert got.topics == ["macro", "regulation"] and got.tickers == ["XAU", "DXY"]
    assert [(e.type, e.text) for e in got.entities] == [("PERSON", "Ada Q."), ("PLACE", "Oslo")]


def test_rejected(spark):
    got = parse(spark, REJECTED)
    assert [a for a, c in zip(REJECTED, got) if c is not None] == []


def test_flatten_missing(spark):
    df = spark.createDataFrame([("not json",)], "t string").withColumn("c", answers.parse_classification("t"))
    row = df.select(*answers.flatten_classification("c")).first()
    assert (row.topics, row.tickers, row.entities) == ([], [], [])
    assert (row.sentiment, row.stance, row.impact) == (None, None, None)


def test_prompts(spark):
    row = spark.range(1).select(answers.render_prompt(F.lit("Buy")).alias("p")).select(
        "p", answers.render_repair_prompt("p").alias("r")
    ).first()
    assert [m.role for m in row.p] == ["system", "user"]
    assert 'Text:\n"""\nBuy\n"""\n\nReturn JSON' in row.p[1].content
    assert len(row.r) == 3 and row.r[2].content == answers.REPAIR_PROMPT


def test_vector_json(spark):
    texts = ["[1, 2.5]", "oops", '[1,"a"]', "{}", "", None, "[]"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [r.v for r in df.select("i", vectors.parse_vector_json("t").alias("v")).orderBy("i").collect()]
    assert got == [[1.0, 2.5], None, None, None, None, None, []]


def test_lexicon(spark):
    df = spark.createDataFrame([("$BTC rally, $ETH surges as SEC approval of ETF",), ("",), (None,), ("bank",)], "t string")
    full, empty, missing, plain = [r.c for r in df.select(lexicon.classify_lexicon("t").alias("c")).collect()]
    assert full.topics == ["crypto", "regulation", "markets"] and full.tickers == ["BTC", "ETH"]
    assert (full.sentiment, full.stance, full.impact) == (1, "bullish", 2)
    assert full.entities[0].text == "SEC" and empty is None and missing is None
    assert (plain.sentiment, plain.stance, plain.impact, plain.topics, plain.tickers) == (0, "neutral", 0, [], [])
