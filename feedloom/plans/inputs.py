"""The given tables reshaped as posts, feed records and stored items.

Each function has its SQL twin in ``oracles.py``.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.session import REQUIRED_CONF, apply_settings

AS_OF = datetime(2024, 2, 1, tzinfo=timezone.utc)
SINCE = "2024-01-15 00:00:00"
STAMP = "yyyy-MM-dd HH:mm:ss.SSSSSS"
SOURCE_OF_LANG = {"en": "telegram", "fr": "twitter", "de": "reddit", "es": "truth_social"}
# One of these ends each post, so that labels have something to find.
PHRASES = (
    "$BTC and $ETH rally after ETF approval",
    "Fed rates and inflation: stocks crash, losses everywhere",
    "SEC lawsuit, $XRP plunges and token losses",
    "nothing to report",
    "bitcoin gains while bonds are falling",
    "Nasdaq futures rising on $SPY, bullish market gains",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if any(spark.conf.get(k, None) != v for k, v in REQUIRED_CONF.items()):
        apply_settings(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for heavy row-wise work on a test table of one split; no operator depends on it."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def work_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of a table for heavy row-wise work."""
    return spread(table(spark, sf_dir, name).select(*columns))


def stamp(col: Column | str) -> Column:
    return F.date_format(col, STAMP)


def decorated_text() -> Column:
    """Document text with a repost marker, a link, emoji, exotic space and decomposed accents."""
    return F.concat(
        F.lit("RT @"), "source", F.lit(": "), "text",
        F.when(F.col("lang") == "fr", F.lit(" e\N{COMBINING ACUTE ACCENT}")).otherwise(F.lit("")),
        F.lit(" https://ex.org/"), F.col("doc_id").cast("string"),
        F.lit(" \N{GRINNING FACE}\N{ROCKET}\N{NO-BREAK SPACE}x"),
    )


def decorated(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = work_table(spark, sf_dir, "documents", "doc_id", "source", "lang", "text")
    return docs.select("doc_id", decorated_text().alias("text"))


def phrase(number: Column | str) -> Column:
    place = (F.col(number) if isinstance(number, str) else number) % len(PHRASES) + 1
    return F.element_at(F.array(*map(F.lit, PHRASES)), place.cast("int"))


def source_of_lang() -> Column:
    return F.create_map(*[F.lit(x) for pair in SOURCE_OF_LANG.items() for x in pair])[F.col("lang")]


def hashed(number: Column | str, n: int) -> Column:
    """A number below n that does not depend on the order of the ids."""
    text = (F.col(number) if isinstance(number, str) else number).cast("string")
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % n


def posted_at(number: str) -> Column:
    """A time of the last 30 days by a hash of the id, so any time filter keeps its share at every scale; no two are equal."""
    micros = F.col(number).cast("decimal(18,6)") / 1_000_000
    return F.lit(AS_OF) - F.make_dt_interval(mins=hashed(number, 43_200).cast("int")) - F.make_dt_interval(secs=micros)


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as unclean posts of the four feeds."""
    docs = work_table(spark, sf_dir, "documents", "doc_id", "source", "lang", "text", "n_chars")
    return docs.select(
        "doc_id",
        source_of_lang().alias("source"),
        F.col("doc_id").cast("string").alias("source_id"),
        F.col("source").alias("author"),
        posted_at("doc_id").alias("published_at"),
        F.concat(decorated_text(), F.lit(" "), phrase("doc_id")).alias("body"),
        F.to_json(F.struct("doc_id", "n_chars")).alias("raw"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as feed rows."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("source"),
        F.col("event_id").cast("string").alias("source_id"),
        F.col("user_id").cast("string").alias("author"),
        F.col("ts").alias("published_at"),
        F.col("props").alias("raw"),
        "event_id",
        "user_id",
        "value",
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as stored items with labels."""
    topic = F.element_at(
        F.array(*map(F.lit, ("crypto", "macro", "regulation", "markets"))), F.col("label") % 4 + 1
    )
    topics = F.when(F.col("label") % 3 == 0, F.array_distinct(F.array(topic, F.lit("markets")))).otherwise(
        F.array(topic)
    )
    sentiment = (F.col("vec_id") % 3 - 1).cast("int")
    return table(spark, sf_dir, "embeddings").select(
        F.element_at(F.array(*map(F.lit, SOURCE_OF_LANG.values())), F.col("label") % 4 + 1).alias("source"),
        F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("source_id"),
        (F.lit(AS_OF) - F.make_dt_interval(hours=hashed("vec_id", 720).cast("int"))).alias("published_at"),
        F.when(F.col("label") != 9, topics).alias("topics"),
        sentiment.alias("sentiment"),
        F.element_at(F.array(*map(F.lit, ("bearish", "neutral", "bullish"))), sentiment + 2).alias("stance"),
        F.concat(F.lit("vector "), F.col("vec_id").cast("string")).alias("text"),
        "embedding",
    )


def stored_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with vectors, and documents stored without one, which a search passes over."""
    plain = table(spark, sf_dir, "documents").select(
        source_of_lang().alias("source"),
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("source_id"),
        posted_at("doc_id").alias("published_at"),
        F.to_json(F.struct("doc_id", "n_chars")).alias("text"),
    )
    return vectors(spark, sf_dir).unionByName(plain, allowMissingColumns=True)


def first_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """The query vector: the embedding with the lowest id (one row)."""
    return table(spark, sf_dir, "embeddings").select(F.min_by("embedding", "vec_id")).first()[0]


def asked_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queries of a search: every vector whose id is divisible by 100."""
    rows = table(spark, sf_dir, "embeddings").filter("vec_id % 100 = 0")
    return rows.select(F.col("vec_id").alias("query_id"), "embedding")


def label_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query vector per label: its embedding with the lowest id."""
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.min_by("embedding", "vec_id").alias("embedding"))


def event_text() -> Column:
    return F.concat(
        F.lit("RT @"), "event_type", F.lit(": user "), F.col("user_id").cast("string"), F.lit(" was at the "),
        "event_type", F.lit(" https://ex.org/"), F.col("event_id").cast("string"), F.lit(" \N{GRINNING FACE}"),
    )


def iso(col: Column | str, suffix: str = "Z") -> Column:
    return F.concat(F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit(suffix))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classifier answers built from events: valid ones and every kind of fault."""
    sentiment = (F.col("event_id") % 3 - 1).cast("string")
    impact = (F.col("user_id") % 3).cast("string")
    stance = F.element_at(F.array(*map(F.lit, ("bullish", "bearish", "neutral"))), (F.col("user_id") % 3 + 1).cast("int"))
    head = F.concat(F.lit('"sentiment":'), sentiment, F.lit(',"stance":"'), stance, F.lit('","impact":'), impact)
    full = F.concat(
        head, F.lit(',"topics":["crypto","'), "event_type", F.lit('"],"tickers":["T'), F.col("user_id").cast("string"),
        F.lit('"],"entities":[{"type":"ORG","text":"'), "event_type", F.lit('"}],"more":{"k":1}'),
    )
    forms = [
        F.concat(F.lit("{"), full, F.lit("}")),
        F.concat(F.lit(" {"), head, F.lit("}\n")),
        F.lit("not json"),
        F.concat(F.lit("{"), head, F.lit("} trailing")),
        F.concat(F.lit("{"), head, F.lit(',"topics":null}')),
        F.concat(F.lit("{"), head, F.lit(',"topics":["a",3]}')),
        F.concat(F.lit("{"), head, F.lit(',"entities":[{"type":"ORG"}]}')),
        F.concat(F.lit('{"sentiment":"'), sentiment, F.lit('","stance":"'), stance, F.lit('","impact":'), impact, F.lit("}")),
        F.concat(F.lit('{"sentiment":'), sentiment, F.lit(',"stance":"up","impact":'), impact, F.lit("}")),
        F.concat(F.lit("["), F.lit("{"), head, F.lit("}]")),
    ]
    return work_table(spark, sf_dir, "events", "event_id", "user_id", "event_type").select(
        "event_id", F.element_at(F.array(*forms), (F.col("event_id") % len(forms) + 1).cast("int")).alias("answer")
    )
