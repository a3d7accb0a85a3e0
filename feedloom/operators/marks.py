"""High-water marks and resume points per source."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions.times import default_since


def high_water_marks(items: DataFrame) -> DataFrame:
    return items.groupBy("source").agg(F.max("published_at").alias("mark"))


def batch_counts(items: DataFrame) -> DataFrame:
    return items.groupBy("source").agg(F.count("*").alias("n_items"))


def resume_points(sources: DataFrame, marks: DataFrame, as_of: datetime, interval_seconds: int) -> DataFrame:
    """Where each source continues: an explicit time, else its mark, else two intervals back.

    ``sources`` has ``source`` and an optional ``explicit_since``.
    """
    explicit: Column = (
        F.col("explicit_since") if "explicit_since" in sources.columns else F.lit(None).cast("timestamp")
    )
    start = F.lit(default_since(as_of, interval_seconds))
    return sources.join(marks, "source", "left").select(
        "source", F.coalesce(explicit, F.col("mark"), start).alias("since")
    )
