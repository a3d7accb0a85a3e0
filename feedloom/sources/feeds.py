"""Landed feed records: reading them and mapping them to items.

Each feed lands as JSON lines, one record per line. Lines are read as text so that
``raw`` keeps the record exactly as it came, unknown fields included, and so that
a malformed line can be set aside whole.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import datetime
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom import schemas
from feedloom.functions.language import detect_language
from feedloom.functions.text import clean_post, first_nonempty
from feedloom.functions.times import epoch_to_timestamp, parse_iso8601, utc
from feedloom.operators.ranking import newest_per_feed

BAD_LINE = "_corrupt_record"
RAW_LINE = "_line"


def _raw_items(
    records: DataFrame,
    source: str,
    source_id: Column,
    body: Column,
    published_at: Column,
    author: Column,
    raw: Column,
    given_lang: Column | None = None,
    feed: Column | None = None,
) -> DataFrame:
    """Common shape of all feeds before cleaning, so that rows are ranked and dropped without that work."""
    return records.select(
        F.lit(source).alias("source"),
        source_id.cast("string").alias("source_id"),
        author.cast("string").alias("author"),
        published_at.alias("published_at"),
        (given_lang if given_lang is not None else F.lit(None).cast("string")).alias("given_lang"),
        body.alias("body"),
        raw.alias("raw"),
        (feed if feed is not None else F.lit(source)).alias("feed"),
    )


def clean_items(rows: DataFrame, max_tokens: int | None = None) -> DataFrame:
    """Mapped rows to items: the text is cleaned first, then its language detected. No limit keeps it whole."""
    return rows.withColumn("text", clean_post("body", max_tokens)).select(
        "source",
        "source_id",
        "author",
        "published_at",
        F.coalesce(F.nullif("given_lang", F.lit("")), detect_language("text")).alias("lang"),
        "text",
        "raw",
        "feed",
        "given_lang",
    )


def _whole_record(records: DataFrame) -> Column:
    if RAW_LINE in records.columns:
        return F.col(RAW_LINE)
    return F.to_json(F.struct(*records.columns), {"ignoreNullFields": "false"})


def raw_channel_message(records: DataFrame) -> DataFrame:
    m = F.col("message")
    return _raw_items(
        records.filter(m["date"].isNotNull()),
        "telegram",
        F.concat_ws(":", "channel", m["id"].cast("string")),
        F.coalesce(m["message"], F.lit("")),
        parse_iso8601(m["date"]),
        m["sender_id"],
        _whole_record(records),
        feed=F.col("channel"),
    )


def raw_search_post(records: DataFrame) -> DataFrame:
    return _raw_items(
        records,
        "twitter",
        F.col("id"),
        F.coalesce("text", F.lit("")),
        parse_iso8601("created_at"),
        F.col("author_id"),
        _whole_record(records),
        given_lang=F.col("lang"),
    )


def raw_submission(records: DataFrame) -> DataFrame:
    return _raw_items(
        records,
        "reddit",
        F.coalesce("name", F.col("id")),
        first_nonempty("selftext", "title"),
        epoch_to_timestamp("created_utc"),
        F.nullif("author", F.lit("")),
        F.to_json(F.struct("id", "subreddit", "title", "url"), {"ignoreNullFields": "false"}),
        feed=F.col("subreddit"),
    )


def raw_status(records: DataFrame) -> DataFrame:
    return _raw_items(
        records,
        "truth_social",
        F.col("id"),
        F.coalesce("content", F.lit("")),
        parse_iso8601("created_at"),
        F.col("account.acct"),
        _whole_record(records),
        given_lang=F.col("language"),
    )


def map_channel_message(records: DataFrame, max_tokens: int | None = None) -> DataFrame:
    return clean_items(raw_channel_message(records), max_tokens)


def map_search_post(records: DataFrame, max_tokens: int | None = None) -> DataFrame:
    return clean_items(raw_search_post(records), max_tokens)


def map_submission(records: DataFrame, max_tokens: int | None = None) -> DataFrame:
    return clean_items(raw_submission(records), max_tokens)


def map_status(records: DataFrame, max_tokens: int | None = None) -> DataFrame:
    return clean_items(raw_status(records), max_tokens)


# Where the constraints of mapped items are read: none of these needs the cleaned
# text or a detected language, so setting rows aside does not repeat that work.
CHECKED = {"source": "source", "source_id": "source_id", "author": "author",
           "published_at": "published_at", "raw": "raw", "lang": "given_lang"}


@dataclass(frozen=True)
class Feed:
    """One kind of landed feed."""

    source: str
    schema: T.StructType
    to_raw: Callable[[DataFrame], DataFrame]
    includes_since: bool = False
    caps_before_since: bool = False
    capped: bool = True

    def to_items(self, records: DataFrame, max_tokens: int | None = None) -> DataFrame:
        return clean_items(self.to_raw(records), max_tokens)


FEEDS: dict[str, Feed] = {
    f.source: f
    for f in (
        Feed("telegram", schemas.CHANNEL_MESSAGE, raw_channel_message, capped=False),
        Feed("twitter", schemas.SEARCH_POST, raw_search_post, includes_since=True),
        Feed("reddit", schemas.SUBMISSION, raw_submission, caps_before_since=True),
        Feed("truth_social", schemas.STATUS, raw_status, caps_before_since=True),
    )
}


def parse_lines(lines: DataFrame, feed: Feed) -> DataFrame:
    """Text lines (column ``value``) to records; a bad line fills ``_corrupt_record``.

    ``inline`` unpacks the parsed record in a generator, which later filters are not
    pushed through, so a line is parsed once and not once per use of a field.
    """
    schema = T.StructType(feed.schema.fields + [T.StructField(BAD_LINE, T.StringType())])
    parsed = F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD_LINE})
    return (
        lines.filter(F.length(F.trim("value")) > 0)
        .select(F.col("value").alias(RAW_LINE), F.inline(F.array(parsed)))
    )


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def stream_lines(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.format("text")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def split_bad_lines(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    bad = F.col(BAD_LINE).isNotNull()
    return records.filter(~bad).drop(BAD_LINE), records.filter(bad).select(F.col(BAD_LINE).alias("line"))


def newer_than(
    items: DataFrame, since: datetime | Column, inclusive: bool = False, keep_undated: bool = False
) -> DataFrame:
    bound = F.lit(utc(since)) if isinstance(since, datetime) else since
    at = F.col("published_at")
    new = at >= bound if inclusive else at > bound
    return items.filter(new | at.isNull() if keep_undated else new)


def matches_any(col: Column | str, terms: Sequence[str]) -> Column:
    """True where the text contains one of the terms, in any case; no terms match nothing."""
    text = F.lower(col)
    return reduce(or_, [text.contains(t.lower()) for t in terms], F.lit(False))


def since_split(
    rows: DataFrame, since: datetime | Column, inclusive: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(rows newer than ``since`` or without a readable time, late rows)."""
    new = newer_than(rows, since, inclusive, keep_undated=True)
    bound = F.lit(utc(since)) if isinstance(since, datetime) else since
    at = F.col("published_at")
    return new, rows.filter(at < bound if inclusive else at <= bound)


def fetch_since(
    records: DataFrame,
    feed: Feed,
    since: datetime | Column,
    keywords: Sequence[str] | None = None,
    newest: int | None = None,
    max_tokens: int | None = None,
    keep_undated: bool = False,
) -> DataFrame:
    """Items of a feed newer than ``since``.

    ``keywords`` keeps records whose text has one of them (search feed only).
    ``newest`` is the page size of the feed's service: with it, only that many
    newest items per feed are taken, before or after the time filter as that
    service does. Landed files hold whole pages already, so the default takes all.
    Rows are ranked and filtered as they came; only those that stay are cleaned.
    ``keep_undated`` passes on items whose time cannot be read, for the constraint check.
    """
    rows = matching(records, feed, keywords)
    cap = newest is not None and feed.capped
    if cap and feed.caps_before_since:
        rows = newest_per_feed(rows, ["source", "feed"], newest)
    rows = newer_than(rows, since, feed.includes_since, keep_undated)
    if cap and not feed.caps_before_since:
        rows = newest_per_feed(rows, ["source", "feed"], newest)
    return clean_items(rows, max_tokens)


def matching(records: DataFrame, feed: Feed, keywords: Sequence[str] | None = None) -> DataFrame:
    """Uncleaned rows of a feed, with ``keywords`` those whose text has one of them."""
    return feed.to_raw(records if keywords is None else records.filter(matches_any("text", keywords)))


def union_sources(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
