"""Offline classifier: keyword lists and regular expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedloom.functions.text import as_column
from feedloom.schemas import CLASSIFICATION

TOPIC_WORDS: dict[str, tuple[str, ...]] = {
    "crypto": ("bitcoin", "btc", "ethereum", "eth", "crypto", "blockchain", "token", "stablecoin"),
    "macro": ("inflation", "fed", "rates", "gdp", "recession", "unemployment", "cpi"),
    "regulation": ("sec", "regulation", "lawsuit", "ban", "compliance", "regulator"),
    "markets": ("stocks", "etf", "market", "markets", "nasdaq", "bonds", "futures"),
}
POSITIVE_WORDS = ("rally", "rallies", "surge", "surges", "pumps", "gain", "gains", "rising", "bullish", "approval")
NEGATIVE_WORDS = ("crash", "crashes", "plunge", "plunges", "dump", "loss", "losses", "falling", "bearish", "hack")
ORGANISATIONS = ("SEC", "ECB", "Fed", "IMF", "Nasdaq")
TICKER_PATTERN = r"\$([A-Z]{2,5})\b"
WORD_BREAK = r"[^\p{L}\p{N}]+"


def classify_lexicon(text: Column | str) -> Column:
    """Classification of a text; NULL for NULL or empty text."""
    c = as_column(text)
    symbols = F.when(c.contains("$"), F.regexp_extract_all(c, F.lit(TICKER_PATTERN), F.lit(1)))
    marked = sorted({w for ws in TOPIC_WORDS.values() for w in ws} | set(POSITIVE_WORDS) | set(NEGATIVE_WORDS))

    def label(hits: Column) -> Column:
        positive = F.size(F.filter(hits, lambda w: w.isin(list(POSITIVE_WORDS))))
        negative = F.size(F.filter(hits, lambda w: w.isin(list(NEGATIVE_WORDS))))
        score = positive - negative
        named = [
            F.when(F.arrays_overlap(hits, F.array(*map(F.lit, words))), F.lit(topic))
            for topic, words in TOPIC_WORDS.items()
        ]
        return F.struct(
            F.array_compact(F.array(*named)).alias("topics"),
            F.signum(score).cast("int").alias("sentiment"),
            F.when(score > 0, "bullish").when(score < 0, "bearish").otherwise("neutral").alias("stance"),
            F.least(F.abs(score), F.lit(2)).alias("impact"),
            F.coalesce(F.array_distinct(symbols), F.array().cast("array<string>")).alias("tickers"),
            F.transform(
                F.array_distinct(F.regexp_extract_all(c, F.lit(rf"\b({'|'.join(ORGANISATIONS)})\b"), F.lit(1))),
                lambda name: F.struct(F.lit("ORG").alias("type"), name.alias("text")),
            ).alias("entities"),
        )

    hits = F.filter(F.split(F.lower(c), WORD_BREAK), lambda w: w.isin(marked))
    return F.when(F.length(c) > 0, F.transform(F.array(hits), label)[0].cast(CLASSIFICATION))
