"""From mapped items to enriched rows: hash, dedup, classify, embed."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions.answers import flatten_classification
from feedloom.functions.lexicon import classify_lexicon
from feedloom.operators.dedup import attach_cached, keep_first, mark_hash
from feedloom.operators.inference import EmbeddingProvider, HashingEmbedder, embed
from feedloom.schemas import LABELS

Classifier = Callable[[DataFrame], DataFrame]


def with_lexicon(items: DataFrame) -> DataFrame:
    """Default classifier: keywords, no model."""
    return items.withColumns(
        {"classification": classify_lexicon("text"), "classification_error": F.lit(None).cast("string")}
    )


def fetch_order() -> list[Column]:
    """The order services hand out posts: newest first. The first copy of a text is kept."""
    return [F.col("published_at").desc(), F.col("source_id")]


def prepare(items: DataFrame, order: Sequence[Column] | None = None) -> DataFrame:
    """Hash the items and keep one of each text per source: what a model has to see.

    This is the one shuffle of a batch.
    """
    return keep_first(mark_hash(items), order or fetch_order())


def enrich(
    unique: DataFrame,
    cache: DataFrame | None = None,
    classifier: Classifier = with_lexicon,
    embedder: Callable[[], EmbeddingProvider] = HashingEmbedder,
) -> DataFrame:
    """Add labels and vectors to prepared items.

    Only texts without a stored vector (``cache``: content_hash, embedding,
    written_at) are sent to the embedder.
    """
    if cache is None:
        known = unique.withColumn("cached_embedding", F.lit(None).cast("array<float>"))
    else:
        known = attach_cached(unique, cache)
    wanted = F.when(F.col("cached_embedding").isNull(), F.col("text"))
    return (
        classifier(known)
        .withColumn("_vector", embed(wanted, embedder))
        .withColumns(
            {
                "embedding": F.coalesce("cached_embedding", "_vector.embedding"),
                "embedding_reused": F.col("cached_embedding").isNotNull(),
                "embedding_error": F.col("_vector.error"),
                **flat_labels(),
            }
        )
        .drop("_vector", "cached_embedding", "classification")
    )


def flat_labels() -> dict[str, Column]:
    return dict(zip(LABELS, flatten_classification("classification")))
