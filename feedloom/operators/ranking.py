"""Newest-N per feed, top-k per group and positions inside large groups."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest_per_feed(items: DataFrame, feed: Sequence[str], n: int, tie_break: str = "source_id") -> DataFrame:
    """The ``n`` newest items of every feed, in two rounds, so that no task sees a whole feed."""
    order = [F.col("published_at").desc(), F.col(tie_break)]
    return top_k_per_group(items, feed, order, n).drop("rank")


def top_k_per_group(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, spread: int = 64
) -> DataFrame:
    """Top ``k`` rows of every group with their ``rank``.

    Two rounds: each group is first cut to ``k`` inside ``spread`` slices, so that
    no task sees a whole group, however few groups there are.
    """
    sliced = df.withColumn("_slice", F.spark_partition_id() % spread)
    inner = Window.partitionBy(*group, "_slice").orderBy(*order)
    outer = Window.partitionBy(*group).orderBy(*order)
    cut = sliced.withColumn("rank", F.row_number().over(inner)).filter(F.col("rank") <= k)
    return (
        cut.drop("_slice", "rank").withColumn("rank", F.row_number().over(outer)).filter(F.col("rank") <= k)
    )


def position_in_group(df: DataFrame, group: Sequence[str], order: str, run_bits: int = 20) -> DataFrame:
    """Add ``position``, the 1-based place of a row in its group by the integer column ``order``.

    A group may hold a third of all rows, so it is cut into runs of
    2**``run_bits`` values of ``order``. Rows are numbered inside a run, and runs are offset by
    the sizes of those before them, which come from a count of the runs.
    """
    runs = df.withColumn("_run", F.shiftright(order, run_bits))
    sizes = runs.groupBy(*group, "_run").agg(F.count("*").alias("_size"))
    before = Window.partitionBy(*group).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *group, "_run", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset")
    )
    inside = Window.partitionBy(*group, "_run").orderBy(order)
    placed = runs.withColumn("_place", F.row_number().over(inside))
    # Null-safe, so that rows without a group stay.
    same = reduce(and_, [placed[c].eqNullSafe(offsets[c]) for c in [*group, "_run"]])
    return placed.join(offsets, same).select(
        *[placed[c] for c in df.columns], (F.col("_place") + F.col("_offset")).alias("position")
    )


def chunk_batches(
    df: DataFrame, group: Sequence[str], order: str, value: str, size: int, run_bits: int = 20
) -> DataFrame:
    """Consecutive values of a group in arrays of ``size``; the last one may be shorter."""
    placed = position_in_group(df.select(*group, order, value), group, order, run_bits)
    chunk = F.expr(f"(position - 1) div {size}").alias("chunk_id")
    entry = F.struct("position", F.col(value).alias("value"))
    return (
        placed.groupBy(*group, chunk)
        .agg(F.array_sort(F.collect_list(entry)).alias("_entries"))
        .select(*group, "chunk_id", F.col("_entries.value").alias("values"))
    )
