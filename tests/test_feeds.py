"""Landed lines to items, per feed."""

from __future__ import annotations

import json
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from feedloom.sources import feeds
from feedloom.sources.feeds import FEEDS

T0 = datetime(2024, 1, 1, 12, tzinfo=timezone.utc)


def at(seconds, zone="Z"):
    return (T0 + timedelta(seconds=seconds)).strftime("%Y-%m-%dT%H:%M:%S") + zone


def land(spark, path, records):
    path.mkdir(parents=True, exist_ok=True)
    lines = [r if isinstance(r, str) else json.dumps(r, ensure_ascii=False) for r in records]
    (path / "part.json").write_text("\n".join(lines) + "\n")
    return feeds.read_lines(spark, str(path))


def fetched(spark, tmp_path, source, records, **options):
    good, bad = feeds.split_bad_lines(feeds.parse_lines(land(spark, tmp_path / source, records), FEEDS[source]))
    items = feeds.fetch_since(good, FEEDS[source], T0, **options)
    return {r.source_id: r for r in items.collect()}, [r.line for r in bad.collect()]


def test_channel_messages(spark, tmp_path):
    def message(i, date, text="hello the world", **more):
        return {"channel": "c", "message": {"id": i, "date": date, "message": text, **more}}

    got, bad = fetched(
        spark, tmp_path, "telegram",
        [message(1, at(0)), message(2, at(1, ""), sender_id=7, views=3), message(3, None), message(4, at(5, "+03:00")),
         message(5, at(9), None), '{"channel": "c", "mess', ""],
    )
    assert set(got) == {"c:2", "c:5"} and bad == ['{"channel": "c", "mess']
    row = got["c:2"]
    assert (row.author, row.lang, row.text, row.feed) == ("7", "en", "hello the world", "c")
    assert json.loads(row.raw)["message"]["views"] == 3
    assert got["c:5"].text == "" and got["c:5"].author is None and got["c:5"].lang is None


def test_search_posts_include_since_and_match_any_keyword(spark, tmp_path):
    def post(i, seconds, text, lang="en"):
        return {"id": i, "text": text, "lang": lang, "created_at": at(seconds), "author_id": 9}

    records = [
        post(1, 0, "Bitcoin up"), post(2, -1, "bitcoin old"), post(3, 5, "the rest"), post(4, 6, "about the ETF", ""),
        post(5, 7, "RT @a: ETH https://x.y moves"),
    ]
    got, _ = fetched(spark, tmp_path, "twitter", records, keywords=["BITCOIN", "etf", "eth"])
    assert set(got) == {"1", "4", "5"}
    assert got["4"].lang == "en" and got["5"].text == "ETH moves" and got["1"].author == "9"
    assert set(fetched(spark, tmp_path, "twitter", records, keywords=[])[0]) == set()


def submission(i, seconds, **more):
    return {"id": str(i), "name": f"t3_{i}", "title": "The title", "selftext": "The body", "url": "u", "subreddit": "btc", "author": "ann", "created_utc": T0.timestamp() + seconds} | more


def test_submissions(spark, tmp_path):
    got, bad = fetched(
        spark, tmp_path, "reddit",
        [submission(1, 0), submission(2, 0.5), submission(3, 1, selftext=""), submission(4, 1, selftext="", title=None, author=None),
         submission(5, 1, name=None, ups=4)],
    )
    assert set(got) == {"t3_2", "t3_3", "t3_4", "5"} and bad == []
    assert got["t3_2"].text == "The body" and got["t3_3"].text == "The title" and got["t3_4"].text == ""
    assert got["t3_4"].author is None and got["t3_2"].author == "ann" and got["t3_2"].feed == "btc"
    assert json.loads(got["t3_4"].raw) == {"id": "4", "subreddit": "btc", "title": None, "url": "u"}


def test_statuses(spark, tmp_path):
    def status(i, seconds, **more):
        return {"id": i, "content": "<p>the news</p>", "language": "xx", "created_at": at(seconds), "account": {"acct": "bob"}} | more

    got, _ = fetched(
        spark, tmp_path, "truth_social",
        [status("1", 0), status("2", 1), status("3", 2, account=None, language=None), {"id": "4", "created_at": at(3)}],
    )
    assert set(got) == {"2", "3", "4"}
    assert (got["2"].author, got["2"].lang, got["2"].text) == ("bob", "xx", "<p>the news</p>")
    assert (got["3"].author, got["3"].lang) == (None, "en") and got["4"].text == ""


def test_page_size_before_the_time_filter(spark, tmp_path):
    records = [submission(i, i - 5, subreddit="a") for i in range(120)] + [submission(i, 1, subreddit="b") for i in range(200, 210)]
    got, _ = fetched(spark, tmp_path, "reddit", records, newest=100)
    assert len([r for r in got.values() if r.feed == "a"]) == 100 and len(got) == 110
    old = [submission(i, -i) for i in range(100)] + [submission(500, -1000)]
    assert fetched(spark, tmp_path, "reddit", old, newest=100)[0] == {}


def test_page_size_after_the_time_filter(spark, tmp_path):
    records = [{"id": i, "text": "t", "lang": "en", "created_at": at(i - 10), "author_id": 1} for i in range(150)]
    got, _ = fetched(spark, tmp_path, "twitter", records, newest=100)
    assert {int(i) for i in got} == set(range(50, 150))


def test_undated_rows_are_passed_on_when_asked(spark, tmp_path):
    good = feeds.parse_lines(land(spark, tmp_path / "x", [{"id": "1", "content": "c", "created_at": "soon"}]), FEEDS["truth_social"])
    assert feeds.fetch_since(good, FEEDS["truth_social"], T0).count() == 0
    assert feeds.fetch_since(good, FEEDS["truth_social"], T0, keep_undated=True).count() == 1


def test_long_text_is_cut_only_when_asked(spark, tmp_path):
    records = [submission(1, 1, selftext=" ".join(["w"] * 2000))]
    assert len(fetched(spark, tmp_path, "reddit", records)[0]["t3_1"].text.split()) == 2000
    assert len(fetched(spark, tmp_path, "reddit", records, max_tokens=1500)[0]["t3_1"].text.split()) == 1500


def test_rows_beyond_the_page_are_not_cleaned(spark):
    rows = spark.createDataFrame([], FEEDS["reddit"].schema)
    plan = feeds.fetch_since(rows, FEEDS["reddit"], T0, newest=5)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("_compose") < plan.rindex("row_number")  # printed from the top: cleaned above the ranking


def test_union(spark):
    a = spark.createDataFrame([("a", 1)], "source string, x int")
    b = spark.createDataFrame([("b", "t")], "source string, y string")
    assert feeds.union_sources([a, b]).filter(F.col("x").isNull()).first().y == "t"


@pytest.mark.parametrize("source", sorted(FEEDS))
def test_item_shape_is_common(spark, tmp_path, source):
    items = FEEDS[source].to_items(spark.createDataFrame([], FEEDS[source].schema), 10)
    assert items.columns == ["source", "source_id", "author", "published_at", "lang", "text", "raw", "feed", "given_lang"]
    assert dict(items.dtypes)["published_at"] == "timestamp"
