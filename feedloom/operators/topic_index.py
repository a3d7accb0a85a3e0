"""Posting lists of topics: a search with a topic filter reads only the folders that hold one of its topics.

Items are written by source and day and numbered inside each folder; for each topic, a bitmap of the places of its items
is kept per folder and run of 32,768 places. A search unites the bitmaps of its topics, reads the folders that are listed, and lets a row
through if its bit is set, before any vector is looked at. Postings are built by aggregates that combine before the shuffle, and a
folder of a third of all items is numbered in runs, so no task sees a whole folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom.functions.answers import list_or_empty
from feedloom.operators.ranking import position_in_group
from feedloom.session import shared_dir

POSTINGS = "topic string, source string, day string, bucket long, bits binary"


@dataclass(frozen=True)
class TopicIndex:
    folder: str
    schema: T.StructType

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(self.schema).parquet(f"{self.folder}/rows")

    def postings(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(POSTINGS).parquet(f"{self.folder}/postings")


def build_topic_index(items: DataFrame, folder: str | None = None) -> TopicIndex:
    """Write items (source, published_at, topics, ...) by source and day, and the postings beside."""
    spark = items.sparkSession
    folder = folder or f"{shared_dir(spark)}/topics-{uuid.uuid4().hex}"
    day = F.coalesce(F.date_format("published_at", "yyyy-MM-dd"), F.lit("none"))
    marked = items.withColumns({"day": day, "_order": F.monotonically_increasing_id()})
    # Written first, so that each item keeps its number.
    marked.write.parquet(f"{folder}/marked")
    marked = spark.read.schema(marked.schema).parquet(f"{folder}/marked")
    placed = position_in_group(marked, ["source", "day"], "_order").drop("_order")
    placed = placed.withColumnRenamed("position", "_place")
    columns = [c for c in placed.columns if c not in ("source", "day")] + ["source", "day"]
    placed = placed.select(*columns)
    placed.hint("rebalance", "source", "day").write.partitionBy("source", "day").parquet(f"{folder}/rows")
    index = TopicIndex(folder, placed.schema)
    each = index.rows(spark).select(F.explode(F.array_distinct(list_or_empty("topics"))).alias("topic"), "source", "day", "_place")
    bits = F.bitmap_construct_agg(F.bitmap_bit_position("_place")).alias("bits")
    each.filter("topic IS NOT NULL").groupBy("topic", "source", "day", F.bitmap_bucket_number("_place").alias("bucket")).agg(bits).sortWithinPartitions("topic").write.parquet(
        f"{folder}/postings"
    )
    return index


def _bit_is_set(bits: Column, bit: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return byte.bitwiseAND(F.pow(F.lit(2), bit % 8).cast("int")) != 0


def items_with_topics(index: TopicIndex, spark: SparkSession, topics: Sequence[str]) -> DataFrame:
    """The items that have one of the topics; only the folders listed for them are read."""
    listed = index.postings(spark).filter(F.col("topic").isin(list(topics)))
    listed = listed.groupBy("source", "day", "bucket").agg(F.bitmap_or_agg("bits").alias("_bits"))
    folders: dict[str | None, list[str]] = {}
    for source, day in sorted(map(tuple, listed.select("source", "day").distinct().collect()), key=repr):  # a row for each folder
        folders.setdefault(source, []).append(day)
    here = [F.col("source").eqNullSafe(F.lit(s)) & F.col("day").isin(days) for s, days in folders.items()]
    rows = index.rows(spark).filter(reduce(or_, here, F.lit(False))).withColumn("_bucket", F.bitmap_bucket_number("_place"))
    listed = listed.withColumnsRenamed({"source": "_source", "day": "_day", "bucket": "_in"})
    same = F.col("source").eqNullSafe(F.col("_source")) & (F.col("day") == F.col("_day")) & (F.col("_bucket") == F.col("_in"))
    found = rows.join(listed, same).filter(_bit_is_set(F.col("_bits"), F.bitmap_bit_position("_place")))
    return found.select(*[c for c in index.schema.fieldNames() if c not in ("_place", "day")])
