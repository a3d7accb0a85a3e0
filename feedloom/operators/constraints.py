"""Checks a row must pass before it is stored."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.schemas import SOURCES

REQUIRED = ("source", "source_id", "published_at", "text", "raw")
# The longest text each column may hold.
MAX_LENGTHS = {"source_id": 255, "author": 255, "lang": 5, "stance": 16}


def select_sources(items: DataFrame, enabled: Sequence[str]) -> DataFrame:
    return items.filter(F.col("source").isin(list(enabled)))


def unknown_sources(items: DataFrame, known: Sequence[str] = SOURCES) -> DataFrame:
    """Rows of a source nobody registered: what an ingest sets aside."""
    return items.filter(~F.coalesce(F.col("source").isin(list(known)), F.lit(False)))


def violations(columns: Mapping[str, str], known: Sequence[str] = SOURCES) -> Column:
    """Names of the rules a row breaks; ``columns`` maps an item field to the column to check."""
    rules = [
        F.when(F.col(columns[f]).isNull(), f"{f} missing") for f in REQUIRED if f in columns
    ] + [
        F.when(F.length(columns[f]) > n, f"{f} longer than {n}") for f, n in MAX_LENGTHS.items() if f in columns
    ]
    if "source" in columns:
        rules.append(F.when(~F.col(columns["source"]).isin(list(known)), "source unknown"))
    return F.array_compact(F.array(*rules))


def repeated_keys(items: DataFrame, key: Sequence[str]) -> DataFrame:
    return items.groupBy(*key).agg(F.count("*").alias("n_rows")).filter("n_rows > 1")


def with_uniqueness(items: DataFrame, key: Sequence[str]) -> DataFrame:
    """Add ``repeated key`` to the ``violations`` of rows whose key occurs again.

    The keys are counted and joined back, so a key of very many rows is a row of the count.
    """
    again = repeated_keys(items, key).select(*key, F.lit("repeated key").alias("_again"))
    broken = F.array_compact(F.array_append("violations", F.col("_again")))
    return items.join(again, list(key), "left").withColumn("violations", broken).drop("_again")


def split_valid(
    items: DataFrame, known: Sequence[str] = SOURCES, columns: Mapping[str, str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """(rows that pass, rows that fail with their ``violations``)."""
    columns = columns or {c: c for c in items.columns}
    checked = items.withColumn("violations", violations(columns, known))
    passed = checked.filter(F.size("violations") == 0).drop("violations")
    return passed, checked.filter(F.size("violations") > 0)
