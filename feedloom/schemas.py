"""Fixed schemas of items, classifications and landed feed records."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# The four feeds an item can come from.
SOURCES = ("telegram", "twitter", "reddit", "truth_social")
# Labels a classification may carry.
SENTIMENTS = (-1, 0, 1)
STANCES = ("bullish", "bearish", "neutral")
IMPACTS = (0, 1, 2)

STRINGS = T.ArrayType(T.StringType())
VECTOR = T.ArrayType(T.FloatType())
ENTITIES = T.ArrayType(
    T.StructType([T.StructField("type", T.StringType()), T.StructField("text", T.StringType())])
)

CLASSIFICATION = T.StructType(
    [
        T.StructField("topics", STRINGS),
        T.StructField("sentiment", T.IntegerType()),
        T.StructField("stance", T.StringType()),
        T.StructField("impact", T.IntegerType()),
        T.StructField("tickers", STRINGS),
        T.StructField("entities", ENTITIES),
    ]
)

# What a feed adapter yields, before enrichment.
NORMALIZED = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("source_id", T.StringType()),
        T.StructField("author", T.StringType()),
        T.StructField("published_at", T.TimestampType()),
        T.StructField("lang", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("raw", T.StringType()),
    ]
)

# The stored table. ``raw`` is the record's JSON text.
ITEMS = T.StructType(
    [T.StructField("id", T.StringType(), False)]
    + [
        T.StructField(f.name, f.dataType, f.name in ("author", "lang"))
        for f in NORMALIZED.fields
    ]
    + [
        T.StructField("tickers", STRINGS),
        T.StructField("entities", ENTITIES),
        T.StructField("topics", STRINGS),
        T.StructField("sentiment", T.IntegerType()),
        T.StructField("stance", T.StringType()),
        T.StructField("impact", T.IntegerType()),
        T.StructField("embedding", VECTOR),
        T.StructField("created_at", T.TimestampType(), False),
        T.StructField("updated_at", T.TimestampType(), False),
    ]
)

LABELS = ("tickers", "entities", "topics", "sentiment", "stance", "impact")
# The fields an upsert overwrites; id and created_at stay.
PAYLOAD = tuple(f.name for f in NORMALIZED.fields) + LABELS + ("embedding",)

CHANNEL_MESSAGE = T.StructType(
    [
        T.StructField("channel", T.StringType()),
        T.StructField(
            "message",
            T.StructType(
                [
                    T.StructField("id", T.LongType()),
                    T.StructField("date", T.StringType()),
                    T.StructField("message", T.StringType()),
                    T.StructField("sender_id", T.LongType()),
                ]
            ),
        ),
    ]
)
SEARCH_POST = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("created_at", T.StringType()),
        T.StructField("author_id", T.LongType()),
    ]
)
SUBMISSION = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("selftext", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("subreddit", T.StringType()),
        T.StructField("author", T.StringType()),
        T.StructField("created_utc", T.DoubleType()),
    ]
)
STATUS = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("language", T.StringType()),
        T.StructField("created_at", T.StringType()),
        T.StructField("account", T.StructType([T.StructField("acct", T.StringType())])),
    ]
)


@dataclass(frozen=True)
class JobSettings:
    """Parameters of an ingest job, with the defaults users know."""

    fetch_interval_seconds: int = 120
    # A limit on stored text; whole texts are hashed and stored without one.
    max_text_tokens: int | None = None
