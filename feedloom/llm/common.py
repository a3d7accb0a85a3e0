"""Shared folder, written intermediate tables, connected components."""

from __future__ import annotations

import uuid

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.session import shared_dir

# A Python task gets so many rows at once; its working memory follows their bytes.
ROWS_PER_ARROW_BATCH = 1000
# So many 64-bit keys, about 32 MB as a hash table, are sent to every executor at most.
BROADCAST_KEYS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/feedloom-llm/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows read back from Parquet in the shared folder: lineage ends there."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_part(folder: str, name: str, columns: list[str] | None = None, filters=None) -> pa.Table:
    """The rows of a folder of Parquet files in the shared folder, read inside a task."""
    system, root = fs.FileSystem.from_uri(f"{folder}/{name}" if name else folder)
    parts = []
    for info in sorted(system.get_file_info(fs.FileSelector(root)), key=lambda i: i.path):
        if info.path.endswith(".parquet"):
            with system.open_input_file(info.path) as source:
                parts.append(pq.read_table(source, columns=columns, filters=filters))
    return pa.concat_tables(parts)


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_ARROW_BATCH))


def row_key() -> Column:
    """A 64-bit key of (doc_id, text): equal for repeated rows, different for other texts of an id and for rows without id."""
    return F.xxhash64("doc_id", "text", F.col("doc_id").isNull(), F.col("text").isNull())


def held_out(doc_id: Column | str) -> Column:
    """True for the rows whose labels are never learned from."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % 5 == 0



def having_key(rows: DataFrame, key: Column, keys: DataFrame, keep: bool = True) -> DataFrame:
    """The rows whose 64-bit key is among ``keys`` (one long column k, distinct), or with ``keep=False`` the others.

    Up to ``BROADCAST_KEYS`` keys are broadcast and the rows stay where they are; more are met by a shuffle.
    """
    keys = written(keys, "keys")
    side = F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys.hint("merge")
    return rows.withColumn("_key", key).join(side.withColumnRenamed("k", "_key"), "_key", "left_semi" if keep else "left_anti").select(*rows.columns)


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for every node of the edges (u, v): the smallest node that it reaches.

    Alternating large-star and small-star steps. Each round is a minimum per node, combined before
    the shuffle, and a join back; a node of a third of all edges is one row of the minimum. Rounds
    grow with the logarithm of the largest component.
    """
    spark = edges.sparkSession
    # Each edge once, from the larger to the smaller node.
    current = written(
        edges.where("u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct(),
        name,
    )
    state = None
    while True:
        both = current.union(current.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        low = written(low, name)
        # Large star: larger neighbours of a node move to the node's minimum.
        large = (
            current.withColumnsRenamed({"u": "big", "v": "u"})
            .join(low, "u")
            .select(F.col("big").alias("u"), F.col("m").alias("v"))
        )
        large = written(large.where("u <> v").distinct(), name)
        # Small star: a node and its smaller neighbours move to the smallest of them.
        low = written(large.groupBy("u").agg(F.min("v").alias("m")), name)
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        current = written(small.union(low.select("u", F.col("m").alias("v"))).distinct(), name)
        seen = current.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if seen == state:
            break
        state = seen
    # Now every edge is (node, component).
    nodes = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
