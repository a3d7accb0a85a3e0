"""Exact duplicates and reuse of vectors by content hash."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.functions.text import content_hash


def mark_hash(items: DataFrame) -> DataFrame:
    """Add ``content_hash`` to items that do not carry one."""
    computed = content_hash("source", "text")
    if "content_hash" in items.columns:
        computed = F.coalesce(F.nullif(F.col("content_hash"), F.lit("")), computed)
    return items.withColumn("content_hash", computed)


def keep_first(items: DataFrame, order: Sequence[Column], key: str = "content_hash") -> DataFrame:
    """One row per ``key``: the first in ``order``.

    Spark limits each group before the shuffle as well (WindowGroupLimit), so a
    text copied into a third of all rows sends one row per map task.
    """
    first = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return items.withColumn("_rank", first).filter("_rank = 1").drop("_rank")


def attach_cached(items: DataFrame, cache: DataFrame) -> DataFrame:
    """Add ``cached_embedding``: the newest stored vector of the same content hash, or NULL.

    ``cache`` (content_hash, embedding, written_at) may be far larger than a batch and
    may repeat a hash. It is first cut to the hashes at hand: when those are few, Spark
    measures that and broadcasts them, so the cache is filtered where it is read and
    never shuffled. Give items that are cheap to read twice (a written table).
    """
    wanted = cache.join(items.select("content_hash"), "content_hash", "left_semi")
    return items.join(newest_vectors(wanted), "content_hash", "left")


def cache_hits(items: DataFrame, cache: DataFrame) -> DataFrame:
    """Items with a stored vector; either side is read once."""
    return items.join(newest_vectors(cache), "content_hash")


def cache_misses(items: DataFrame, cache: DataFrame) -> DataFrame:
    """Distinct hashes without a stored vector: the only texts a model has to see."""
    hashes = items.filter(F.length("text") > 0).groupBy("content_hash").agg(F.count("*").alias("n_items"))
    return hashes.join(cache.select("content_hash"), "content_hash", "left_anti")


def newest_vectors(cache: DataFrame) -> DataFrame:
    """One vector per hash, the one written last."""
    newest = F.max_by("embedding", "written_at").alias("cached_embedding")
    return cache.groupBy("content_hash").agg(newest)
