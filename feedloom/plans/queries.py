"""Every registered query: an operator of the library over the given tables."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.functions import answers, language, lexicon, text, times
from feedloom.functions import vectors as vec
from feedloom.operators import constraints, dedup, inference, language_model, latent, marks, merge, ranking, search, topic_index, vector_index
from feedloom.plans import enrich as enrichment
from feedloom.plans import inputs
from feedloom.plans.inputs import AS_OF, SINCE, stamp, table, work_table
from feedloom.schemas import LABELS, PAYLOAD
from feedloom.session import shared_dir, staged
from feedloom.sources import feeds
from feedloom.sources.store import lookup_by_source_id
from feedloom.streaming import lateness

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def joined(col: Column | str) -> Column:
    return F.array_join(col, ",")


def since() -> Column:
    """The resume time as the events store it, so that the filter reaches the scan."""
    return F.lit(SINCE).cast("timestamp_ntz")


# ---- text ----------------------------------------------------------------------


def _on_decorated(spark: SparkSession, sf_dir: str, fn: Callable[[str], Column]) -> DataFrame:
    return inputs.decorated(spark, sf_dir).select("doc_id", fn("text").alias("text"))


@query
def normalize_text(spark, sf_dir):
    return _on_decorated(spark, sf_dir, text.normalize_text)


@query
def strip_urls(spark, sf_dir):
    return _on_decorated(spark, sf_dir, text.strip_urls)


@query
def strip_emoji(spark, sf_dir):
    return _on_decorated(spark, sf_dir, text.strip_emoji)


@query
def strip_rt_prefix(spark, sf_dir):
    return _on_decorated(spark, sf_dir, text.strip_rt_prefix)


@query
def collapse_whitespace(spark, sf_dir):
    return _on_decorated(spark, sf_dir, text.collapse_whitespace)


@query
def truncate_tokens(spark, sf_dir):
    return work_table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", text.truncate_tokens("text", 1500).alias("text"))


@query
def ensure_max_length(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.ensure_max_length("text", 280).alias("text"))


@query
def detect_language(spark, sf_dir):
    return work_table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", language.detect_language("text").alias("detected"))


@query
def detect_language_learned(spark, sf_dir):
    """Profiles from four fifths of the documents, scores of all."""
    docs = work_table(spark, sf_dir, "documents", "doc_id", "lang", "text")
    model = language_model.fit_language_model(docs.filter(inputs.hashed("doc_id", 5) != 0))
    found = language_model.detect_languages(docs, model)
    return found.select("doc_id", "detected", F.round("score", 6).alias("score"))


@query
def content_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.content_hash("source", "text").alias("content_hash"))


@query
def dedup_keep_first(spark, sf_dir):
    docs = dedup.mark_hash(table(spark, sf_dir, "documents"))
    return dedup.keep_first(docs, [F.col("doc_id")]).select("content_hash", "doc_id", "source", "lang")


# ---- time ----------------------------------------------------------------------


@query
def parse_iso8601(spark, sf_dir):
    kind = F.col("event_type")
    written = (
        F.when(kind == "click", inputs.iso("ts", ""))
        .when(kind == "view", inputs.iso("ts"))
        .when(kind == "purchase", inputs.iso("ts", "+03:00"))
        .when((kind == "signup") & (F.col("event_id") % 2 == 0), F.date_format("ts", "yyyy-MM-dd"))
        .when(kind == "signup", F.concat(F.lit("2024-W"), F.lpad((F.col("event_id") % 60).cast("string"), 2, "0"), F.lit("-3T10:30:00Z")))
        .otherwise(F.lit("yesterday"))
    )
    return table(spark, sf_dir, "events").select("event_id", stamp(times.parse_iso8601(written)).alias("parsed"))


@query
def epoch_to_timestamp(spark, sf_dir):
    # Seconds with a fraction of quarters, which a double holds exactly.
    seconds = F.unix_timestamp(F.col("ts").cast("timestamp")) + (F.col("event_id") % 4) * 0.25
    at = times.epoch_to_timestamp(seconds.cast("double"))
    return table(spark, sf_dir, "events").select(
        "event_id", stamp(at).alias("at"), times.format_iso_z(at).alias("iso"),
        times.format_iso_z(F.col("ts").cast("timestamp")).alias("iso_exact"),
    )


# ---- feeds ---------------------------------------------------------------------


def _item_view(items: DataFrame) -> DataFrame:
    return items.select("source", "source_id", "author", stamp("published_at").alias("published_at"), "lang", "text", "raw")


def _feed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return work_table(spark, sf_dir, "events", "event_id", "event_type", "ts", "user_id")


@query
def map_channel_message(spark, sf_dir):
    kind = F.col("event_type")
    message = F.struct(
        F.col("event_id").alias("id"),
        F.when(kind != "error", inputs.iso("ts", "")).alias("date"),
        F.when(kind != "view", inputs.event_text()).alias("message"),
        F.col("user_id").alias("sender_id"),
    )
    records = _feed_events(spark, sf_dir).select(kind.alias("channel"), message.alias("message"))
    return _item_view(feeds.map_channel_message(records))


@query
def map_search_post(spark, sf_dir):
    records = _feed_events(spark, sf_dir).select(
        F.col("event_id").alias("id"),
        inputs.event_text().alias("text"),
        F.when(F.col("event_type") == "click", F.lit("")).otherwise(F.lit("xx")).alias("lang"),
        inputs.iso("ts").alias("created_at"),
        F.col("user_id").alias("author_id"),
    )
    return _item_view(feeds.map_search_post(records))


@query
def map_submission(spark, sf_dir):
    kind = F.col("event_type")
    event_id = F.col("event_id").cast("string")
    records = _feed_events(spark, sf_dir).select(
        event_id.alias("id"),
        F.when(kind != "error", F.concat(F.lit("t3_"), event_id)).alias("name"),
        F.when(kind != "signup", F.concat(F.lit("Title of "), kind)).alias("title"),
        F.when(kind.isin("view", "signup"), F.lit("")).otherwise(inputs.event_text()).alias("selftext"),
        F.concat(F.lit("https://ex.org/"), event_id).alias("url"),
        kind.alias("subreddit"),
        F.col("user_id").cast("string").alias("author"),
        F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double").alias("created_utc"),
    )
    return _item_view(feeds.map_submission(records))


@query
def map_status(spark, sf_dir):
    kind = F.col("event_type")
    records = _feed_events(spark, sf_dir).select(
        F.col("event_id").cast("string").alias("id"),
        F.when(kind != "error", inputs.event_text()).alias("content"),
        F.when(kind == "click", F.lit("en")).alias("language"),
        inputs.iso("ts").alias("created_at"),
        F.when(kind != "view", F.struct(F.col("user_id").cast("string").alias("acct"))).alias("account"),
    )
    return _item_view(feeds.map_status(records))


@query
def ingest_since(spark, sf_dir):
    new = feeds.newer_than(inputs.events(spark, sf_dir), since())
    return new.select("source", "source_id", "author", stamp("published_at").alias("published_at"), "raw")


@query
def ingest_keyword_or(spark, sf_dir):
    records = work_table(spark, sf_dir, "documents", "doc_id", "text", "lang", "n_chars").select(
        F.col("doc_id").alias("id"),
        "text",
        "lang",
        inputs.iso(inputs.posted_at("doc_id")).alias("created_at"),
        F.col("n_chars").alias("author_id"),
    )
    items = feeds.fetch_since(
        records, feeds.FEEDS["twitter"], datetime(2024, 1, 20, tzinfo=timezone.utc),
        keywords=["NICHT", "avec", "which", " ist ", " les "], newest=100,
    )
    return items.select("source_id", stamp("published_at").alias("published_at"), "lang", "text")


@query
def newest_n_per_feed(spark, sf_dir):
    newest = ranking.newest_per_feed(inputs.events(spark, sf_dir), ["source"], 100)
    return feeds.newer_than(newest, since()).select("source", "source_id", stamp("published_at").alias("published_at"))


@query
def union_sources(spark, sf_dir):
    chat = table(spark, sf_dir, "conversations").select(
        F.col("role").alias("source"), F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("source_id"), "text"
    )
    docs = table(spark, sf_dir, "documents").select("source", F.col("doc_id").cast("string").alias("source_id"), "text", "lang")
    rows = inputs.events(spark, sf_dir).select("source", "source_id", "raw")
    return feeds.union_sources([chat, docs, rows])


@query
def enabled_sources(spark, sf_dir):
    return constraints.select_sources(inputs.events(spark, sf_dir), ["click", "view"]).select("source", "source_id", "raw")


@query
def reject_unknown_source(spark, sf_dir):
    known = ("click", "view", "purchase", "signup")
    return constraints.unknown_sources(inputs.events(spark, sf_dir), known).select("source", "source_id", "raw")


@query
def constraint_violations(spark, sf_dir):
    """Every rule is broken by some rows; a key counts as repeated when it occurs again among all rows."""
    value, number = F.col("value"), F.col("event_id")
    rows = inputs.events(spark, sf_dir).select(
        F.when(number % 97 != 0, F.col("source")).alias("source"),
        F.when(number % 89 == 0, F.repeat(F.col("source_id"), 260)).when(value < 30, (number - number % 83 % 2).cast("string")).alias("source_id"),
        F.when(value > 20, F.repeat(F.col("author"), 200)).otherwise(F.col("author")).alias("author"),
        F.when(number % 79 != 0, F.col("published_at")).alias("published_at"),
        F.when(F.col("source") == "signup", F.lit("en-GB-x")).otherwise(F.lit("en")).alias("lang"),
        F.when(number % 73 != 0, F.lit("")).alias("text"),
        F.when(number % 71 == 0, F.lit("very undecided indeed")).otherwise(F.lit("neutral")).alias("stance"),
        F.when(value >= 2, F.col("raw")).alias("raw"),
        "event_id",
    )
    columns = {c: c for c in rows.columns}
    checked = rows.withColumn("violations", constraints.violations(columns, ("click", "view", "purchase", "signup")))
    failed = constraints.with_uniqueness(checked, ["source", "source_id"]).filter(F.size("violations") > 0)
    return failed.select("event_id", F.array_join(F.array_sort("violations"), "; ").alias("violations"))


# ---- marks, upsert, cache --------------------------------------------------------


@query
def high_water_marks(spark, sf_dir):
    return marks.high_water_marks(inputs.events(spark, sf_dir)).select("source", stamp("mark").alias("mark"))


@query
def batch_counts(spark, sf_dir):
    items = dedup.keep_first(
        dedup.mark_hash(table(spark, sf_dir, "documents")).select("content_hash", "source", "doc_id"), [F.col("doc_id")]
    )
    return marks.batch_counts(items)


@query
def resume_points(spark, sf_dir):
    rows = inputs.events(spark, sf_dir)
    names = rows.select("source").union(table(spark, sf_dir, "documents").select("source")).distinct()
    explicit = F.when(F.col("source") == "click", F.lit(SINCE).cast("timestamp"))
    known = marks.high_water_marks(rows).withColumn("mark", F.col("mark").cast("timestamp"))
    points = marks.resume_points(names.withColumn("explicit_since", explicit), known, AS_OF, 120)
    return points.select("source", stamp("since").alias("since"))


@query
def upsert_last_wins(spark, sf_dir):
    """The store after a first batch (before ``SINCE``) and a second one, one item per user."""
    payload = ("author", "published_at", "raw", "source_id", "source")
    rows = inputs.events(spark, sf_dir)
    old = F.col("published_at") <= since()
    first = F.lit(SINCE).cast("timestamp")
    current = merge.reduce_batch(rows.filter(old), ["author"], payload, ["published_at", "event_id"]).drop("flips")
    current = current.withColumns({"created_at": first, "updated_at": first})
    merged = merge.upsert(
        current, rows.filter(~old), F.lit(AS_OF), ["author"], payload, ["published_at", "event_id"]
    )
    return merged.select(
        "author", "source", "source_id", "raw", stamp("published_at").alias("published_at"),
        stamp("created_at").alias("created_at"), stamp("updated_at").alias("updated_at"),
    )


@query
def upsert_labelled(spark, sf_dir):
    """Labels through an upsert: changed, unchanged and failed ones, in both kinds of key.

    With ``source_id`` as the key an id that moves to another source stays one item, and a failed classification
    overwrites; with source and id as the key it becomes a second item, and earlier labels are kept.
    """
    number = F.col("source_id").substr(F.lit(2), F.length("source_id")).cast("int")
    first = inputs.vectors(spark, sf_dir).withColumn("impact", number % 3).withColumns(
        {"tickers": F.array(F.concat(F.lit("T"), "stance")), "entities": F.lit(None).cast("array<struct<type:string,text:string>>")}
    )
    failed = number % 6 == 0
    second = first.filter(number % 2 == 0).withColumns(
        {
            "source": F.when(number % 4 == 0, F.lit("reddit")).otherwise(F.col("source")),
            "text": F.when(number % 8 == 0, F.lit("edited")).otherwise(F.col("text")),
            "tickers": F.when(~failed, F.col("tickers")),
            "topics": F.when(~failed, F.col("topics")),
            **{c: F.when(~failed, F.col(c)) for c in ("sentiment", "stance", "impact")},
        }
    )
    payload = ("source", "source_id", "published_at", "text", *LABELS)
    start, parts = F.lit(SINCE).cast("timestamp"), []
    for mode, key, keep in (("id", ("source_id",), False), ("pair", merge.KEY, True)):
        current = merge.upsert(None, first, start, key, payload, ("published_at",))
        merged = merge.upsert(current, second, F.lit(AS_OF), key, payload, ("published_at",), keep)
        parts.append(
            merged.select(
                F.lit(mode).alias("mode"), "source", "source_id", "text", joined("topics").alias("topics"), joined("tickers").alias("tickers"),
                "sentiment", "stance", "impact", stamp("created_at").alias("created_at"), stamp("updated_at").alias("updated_at"),
            )
        )
    return parts[0].unionByName(parts[1])


@query
def late_rows(spark, sf_dir):
    """Two runs of a stream over landed events: the second is judged by what the first has left in the state."""
    rows = inputs.events(spark, sf_dir).select("source", "source_id", "published_at", "event_id")
    odd = F.col("event_id") % 2 == 1
    landing = f"{shared_dir(spark)}/late-rows-{uuid.uuid4().hex}"
    stream = spark.readStream.schema("source string, source_id string, published_at timestamp_ntz").parquet(f"{landing}/landed/*")
    judge = lateness.LatenessStream(spark, f"{landing}/job", slices=4)
    for run, some in (("1", ~odd & (F.col("published_at") <= since())), ("2", odd)):
        rows.filter(some).drop("event_id").write.parquet(f"{landing}/landed/{run}")
        judged = judge.run(stream, run)
    return lateness.late_counts(judged)


@query
def lookup_by_source_id(spark, sf_dir, find=lookup_by_source_id):
    """The page of one URL: the key is a stored column, so that the comparison reaches the scan."""
    pages = table(spark, sf_dir, "pages").select(F.col("url").alias("source_id"), "page_id")
    wanted = pages.agg(F.min_by("source_id", "page_id")).first()[0]
    return find(pages, wanted)


def _hashed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All documents with their hash, and a cache filled by the English ones."""
    docs = dedup.mark_hash(table(spark, sf_dir, "documents"))
    cache = docs.filter("lang = 'en'").select(
        "content_hash", F.array(F.col("n_chars").cast("float")).alias("embedding"), F.col("doc_id").alias("written_at")
    )
    return docs, cache


@query
def embedding_cache_hits(spark, sf_dir):
    docs, cache = _hashed(spark, sf_dir)
    hits = dedup.cache_hits(docs.select("doc_id", "content_hash"), cache)
    return hits.select("doc_id", "content_hash", F.col("cached_embedding")[0].cast("double").alias("first_value"))


@query
def embedding_cache_misses(spark, sf_dir):
    docs, cache = _hashed(spark, sf_dir)
    return dedup.cache_misses(docs, cache)


# ---- answers and prompts ---------------------------------------------------------


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.answers(spark, sf_dir).withColumn("c", answers.parse_classification("answer"))


@query
def parse_classification(spark, sf_dir):
    c = F.col("c")
    return _parsed(spark, sf_dir).select(
        "event_id",
        c.isNotNull().alias("valid"),
        joined(c.topics).alias("topics"),
        c.sentiment.alias("sentiment"),
        c.stance.alias("stance"),
        c.impact.alias("impact"),
        joined(c.tickers).alias("tickers"),
        joined(F.transform(c.entities, lambda e: F.concat_ws("=", e.type, e.text))).alias("entities"),
    )


@query
def flatten_classification(spark, sf_dir):
    flat = _parsed(spark, sf_dir).select("event_id", *answers.flatten_classification("c"))
    return flat.select(
        "event_id", joined("topics").alias("topics"), joined("tickers").alias("tickers"),
        F.size("entities").alias("n_entities"), "sentiment", "stance", "impact",
    )


@query
def parse_vector_json(spark, sf_dir):
    written = F.when(F.col("label") == 3, F.lit("[0.1, oops")).otherwise(F.to_json("embedding"))
    parsed = table(spark, sf_dir, "embeddings").select("vec_id", vec.parse_vector_json(written).alias("v"))
    total = F.aggregate(F.col("v").cast("array<double>"), F.lit(0.0), lambda s, x: s + x)
    return parsed.select("vec_id", F.when(F.col("v").isNotNull(), F.size("v")).alias("dim"), F.round(total, 6).alias("total"))


@query
def render_prompt(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(answers.render_prompt("text")))
    return docs.select("doc_id", F.col("pos").alias("turn"), "col.role", "col.content")


@query
def render_repair_prompt(spark, sf_dir):
    rejected = _parsed(spark, sf_dir).filter("c IS NULL")
    turns = answers.render_repair_prompt(answers.render_prompt("answer"))
    return rejected.select("event_id", F.posexplode(turns)).select(
        "event_id", F.col("pos").alias("turn"), "col.role", "col.content"
    )


@query
def chunk_batches(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    chunks = ranking.chunk_batches(docs, ["source"], "doc_id", "n_chars", 50)
    return chunks.select(
        "source", "chunk_id", F.size("values").alias("n"),
        joined(F.transform("values", lambda v: v.cast("string"))).alias("sizes"),
    )


# ---- models ----------------------------------------------------------------------


class RuleChat:
    """Stand-in for a chat model: how it behaves depends on the length of the question only.

    0: answers at once, 1: answers when asked again, 2: never valid, 3: fails.
    """

    def chat(self, messages: list[dict[str, str]], max_tokens: int) -> str:
        length = len(messages[1]["content"]) - len(answers.USER_PROMPT_HEAD) - len(answers.USER_PROMPT_TAIL)
        kind = length % 4
        if kind == 3:
            raise RuntimeError("no connection")
        if kind == 0 or (kind == 1 and len(messages) == 3):
            return json.dumps(
                {"topics": ["regulation"], "sentiment": length % 3 - 1, "stance": "neutral", "impact": length % 3,
                 "tickers": [f"T{length}"], "entities": [{"type": "PLACE", "text": "Oslo"}]}
            )
        return "I cannot say"


def no_pause(seconds: float) -> None:
    return None


@query
def classify_two_pass(spark, sf_dir):
    docs = work_table(spark, sf_dir, "documents", "doc_id", "text")
    c = F.col("classification")
    return inference.classify_two_pass(docs, RuleChat, pause=no_pause).select(
        "doc_id", "asked_twice", c.sentiment.alias("sentiment"), c.impact.alias("impact"),
        joined(c.tickers).alias("tickers"), F.col("classification_error").alias("error"),
    )


def _phrased(spark: SparkSession, sf_dir: str) -> DataFrame:
    return work_table(spark, sf_dir, "documents", "doc_id", "text").select(
        "doc_id", F.concat("text", F.lit(" "), inputs.phrase("doc_id")).alias("text")
    )


def _label_view(c: Column) -> list[Column]:
    names = F.transform(c.entities, lambda e: F.concat_ws("=", e.type, e.text))
    return [
        joined(c.topics).alias("topics"), c.sentiment.alias("sentiment"), c.stance.alias("stance"),
        c.impact.alias("impact"), joined(F.array_sort(c.tickers)).alias("tickers"),
        joined(F.array_sort(names)).alias("entities"),
    ]


@query
def classify_lexicon(spark, sf_dir):
    labelled = _phrased(spark, sf_dir).select("doc_id", lexicon.classify_lexicon("text").alias("c"))
    return labelled.select("doc_id", *_label_view(F.col("c")))


def _entries() -> list[Column]:
    return [F.col("pos").alias("dim"), F.round(F.col("col").cast("double"), 6).alias("weight")]


@query
def embed_hashing(spark, sf_dir):
    docs = work_table(spark, sf_dir, "documents", "doc_id", "text").select(
        "doc_id", inference.embed("text", inference.HashingEmbedder).embedding.alias("v")
    )
    return docs.select("doc_id", F.posexplode("v")).filter("col > 0").select("doc_id", *_entries())


@query
def embed_texts(spark, sf_dir):
    """Vectors of distinct texts only, with a weighted sum of each to compare."""
    docs = dedup.mark_hash(table(spark, sf_dir, "documents")).select("content_hash", "text", "doc_id")
    unique = dedup.keep_first(docs, [F.col("doc_id")])
    vectors = unique.select("content_hash", inference.embed("text", inference.HashingEmbedder).alias("e"))
    return vectors.select("content_hash", F.size("e.embedding").alias("dim"), _weighted("e.embedding").alias("total"))


@query
def embed_latent(spark, sf_dir):
    """An embedder fitted on the documents, and the vectors of all of them: their size and length."""
    docs = work_table(spark, sf_dir, "documents", "doc_id", "text")
    provider = latent.fit_latent(docs, f"{shared_dir(spark)}/latent-{uuid.uuid4().hex}")
    vectors = docs.select("doc_id", inference.embed("text", provider).embedding.alias("v"))
    squares = F.aggregate(F.col("v").cast("array<double>"), F.lit(0.0), lambda s, x: s + x * x)
    return vectors.select("doc_id", F.size("v").alias("dim"), F.round(F.sqrt(squares), 4).alias("length"))


def _weighted(vector: str) -> Column:
    terms = F.transform(F.col(vector).cast("array<double>"), lambda x, i: x * (i + 1))
    return F.round(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x), 4)


# ---- vectors and search ------------------------------------------------------------


@query
def cosine_similarity(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    first = inputs.label_vectors(spark, sf_dir).withColumnRenamed("embedding", "first")
    score = vec.cosine_similarity("embedding", "first")
    return rows.join(first, "label").select("vec_id", "label", F.round(score, 6).alias("score"))


def _hits(hits: DataFrame) -> DataFrame:
    return hits.select("source_id", F.round("score", 6).alias("score"))


@query
def semantic_search(spark, sf_dir):
    return _hits(search.semantic_search(inputs.stored_items(spark, sf_dir), inputs.first_vector(spark, sf_dir)))


@query
def search_filtered(spark, sf_dir):
    filters = search.SearchFilters(topics=["crypto", "markets"], sentiment=1, stance="bullish")
    return _hits(
        search.semantic_search(inputs.stored_items(spark, sf_dir), inputs.first_vector(spark, sf_dir), filters)
    )


@query
def search_recent(spark, sf_dir):
    filters = search.SearchFilters(since_days=7, sentiment=0)
    return _hits(
        search.semantic_search(
            inputs.stored_items(spark, sf_dir), inputs.first_vector(spark, sf_dir), filters, as_of=AS_OF
        )
    )


@query
def search_result_view(spark, sf_dir):
    hits = search.semantic_search(inputs.stored_items(spark, sf_dir), inputs.first_vector(spark, sf_dir), limit=10)
    return search.search_result_view(hits).withColumn("topics", joined("topics"))


@query
def topic_overlap(spark, sf_dir):
    wanted = text.split_list(F.lit("crypto,macro"))
    overlap = F.coalesce(F.arrays_overlap(answers.list_or_empty("topics"), wanted), F.lit(False))
    return inputs.stored_items(spark, sf_dir).select("source_id", overlap.alias("overlaps"))


@query
def semantic_search_multi(spark, sf_dir):
    hits = search.semantic_search_multi(inputs.stored_items(spark, sf_dir), inputs.asked_vectors(spark, sf_dir), k=10)
    return hits.select("query_id", "source_id", F.round("score", 6).alias("score"), "rank")


@query
def search_by_topic(spark, sf_dir):
    """A filtered search that reads only the folders that the posting lists of its topics name."""
    index = topic_index.build_topic_index(inputs.stored_items(spark, sf_dir))
    items = topic_index.items_with_topics(index, spark, ["macro", "regulation"])
    return _hits(search.semantic_search(items, inputs.first_vector(spark, sf_dir), search.SearchFilters(sentiment=1)))


@query
def search_indexed(spark, sf_dir):
    """The same searches through the index of cells, in its exact mode."""
    index = vector_index.build_index(inputs.stored_items(spark, sf_dir))
    hits = vector_index.search_indexed(index, inputs.asked_vectors(spark, sf_dir), k=10)
    return hits.select("query_id", "source_id", F.round("score", 6).alias("score"), "rank")


# ---- everything ------------------------------------------------------------------


@query
def search_text(spark, sf_dir):
    """Documents enriched, the query text embedded, the winners' rows fetched after the ranking."""
    docs = work_table(spark, sf_dir, "documents", "doc_id", "lang", "text")
    items = docs.select(
        inputs.source_of_lang().alias("source"), F.col("doc_id").cast("string").alias("source_id"),
        inputs.posted_at("doc_id").alias("published_at"), F.concat("text", F.lit(" "), inputs.phrase("doc_id")).alias("text"),
    )
    rows = enrichment.enrich(enrichment.prepare(items))
    filters = search.SearchFilters(stance="bullish", since_days=3)
    narrow = rows.select("source", "source_id", "published_at", "stance", "embedding")
    hits = search.search_by_text(narrow, "bitcoin rally after ETF approval", inference.HashingEmbedder, filters, 10, AS_OF)
    return search.search_result_view(search.join_winners(rows, hits)).select("item", F.col("score"), joined("topics").alias("topics"), "sentiment", "stance", "text")


def _cleaned_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = inputs.posts(spark, sf_dir).select(
        "doc_id", "source", "source_id", "author", "published_at", text.clean_post("body").alias("text"), "raw"
    )
    return posts.withColumn("lang", language.detect_language("text"))


def _stored_view(stored: DataFrame) -> DataFrame:
    return stored.select(
        "id", "source", "source_id", "author", stamp("published_at").alias("published_at"), "lang", "text", "raw",
        joined("topics").alias("topics"), "sentiment", "stance", "impact",
        joined(F.array_sort("tickers")).alias("tickers"), F.size("entities").alias("n_entities"),
        F.size("embedding").alias("dim"), _weighted("embedding").alias("total"),
        stamp("created_at").alias("created_at"), stamp("updated_at").alias("updated_at"),
    )


@query
def enrich_items(spark, sf_dir):
    """Posts cleaned, deduplicated, labelled, embedded and stored into an empty table."""
    rows = enrichment.enrich(enrichment.prepare(_cleaned_posts(spark, sf_dir).drop("doc_id")))
    stored = merge.upsert(None, rows, F.lit(AS_OF), merge.KEY, PAYLOAD, ("published_at", "content_hash"))
    return _stored_view(stored)


@query
def enrich_into_store(spark, sf_dir):
    """Posts cleaned, deduplicated, labelled and embedded, stored over an earlier batch whose vectors are reused."""
    # As the ingest does, each step is written: what is read again is not made again.
    items = staged(_cleaned_posts(spark, sf_dir), "posts")
    earlier = staged(enrichment.enrich(enrichment.prepare(items.filter("doc_id % 5 = 0").drop("doc_id"))), "earlier")
    cache = earlier.select("content_hash", "embedding", F.lit(SINCE).cast("timestamp").alias("written_at")).filter("embedding IS NOT NULL")
    order = ("published_at", "content_hash")
    current = merge.upsert(None, earlier, F.lit(SINCE).cast("timestamp"), merge.KEY, PAYLOAD, order)
    unique = staged(enrichment.prepare(items.drop("doc_id")), "prepared")
    rows = enrichment.enrich(unique, cache)
    stored = merge.upsert(current, rows, F.lit(AS_OF), merge.KEY, PAYLOAD, order)
    return _stored_view(stored)
