"""Clusters of integer vectors around moving centroids; distances are gathered from tables of squared differences.

Vectors become integers floor(256 x) and are cut into blocks once. A block keeps, for each dimension, the integer values
that occur in it and for each vector the place of its value among them. In each round a task tabulates, for each
dimension of a block, the squared difference of every occurring value and every centroid; a distance is then the sum of
one table entry per dimension. Everything is 64-bit integers, so the result is exact and does not depend on how the rows
are dealt. A task returns one row of counts and sums per centroid, which are added in Spark; the driver sees centroids only.

Defined results: vectors of another length than ``size``, null ones and those with null or non-finite entries are
left out; repeated rows and rows of one id are vectors of their own; rows without id are clustered, but are no starting
centroid; equal hashes start in the order of their vectors; with fewer vectors than centroids each is one; a centroid
without vectors stays; an entry beyond 2^27 in size is an error, since its distances would not fit a long; other columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import small_batches, written
from feedloom.llm.whitening import integers, matrix

LARGEST = 2**27
# Centroids whose distances to the vectors of a block are held at once.
CENTROIDS_AT_ONCE = 256


def blocks_of(rows: DataFrame, size: int) -> DataFrame:
    """(ids, no_id, values, starts, codes): one row for each batch of vectors (vec_id, x)."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column(1))
            if np.abs(x).max() > LARGEST:
                raise ValueError("an entry of a vector is too large to be clustered")
            values, codes, starts = [], np.zeros((size, len(x)), np.uint32), [0]
            for d in range(size):
                occurring, codes[d] = np.unique(x[:, d], return_inverse=True)
                values.append(occurring)
                starts.append(starts[-1] + len(occurring))
            yield pa.RecordBatch.from_pydict(
                {
                    "ids": pa.array([batch.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).tobytes()], pa.binary()),
                    "no_id": pa.array([batch.column(0).is_null().to_numpy(zero_copy_only=False).astype(np.uint8).tobytes()], pa.binary()),
                    "values": pa.array([np.concatenate(values).astype(np.int64).tobytes()], pa.binary()),
                    "starts": pa.array([np.array(starts, np.int64).tobytes()], pa.binary()),
                    "codes": pa.array([codes.tobytes()], pa.binary()),
                }
            )

    return rows.mapInArrow(encode, "ids binary, no_id binary, values binary, starts binary, codes binary")


class Block:
    """A decoded row of ``blocks_of``."""

    def __init__(self, row: dict[str, bytes], size: int):
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.no_id = np.frombuffer(row["no_id"], np.uint8).astype(bool)
        self.codes = np.frombuffer(row["codes"], np.uint32).reshape(size, -1)
        starts, values = np.frombuffer(row["starts"], np.int64), np.frombuffer(row["values"], np.int64)
        self.values = [values[a:b] for a, b in zip(starts, starts[1:])]

    def nearest(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, squared distance) of the nearest centroid of each vector; of equals the smallest number."""
        number = np.zeros(len(self.ids), np.int64)
        least = np.full(len(self.ids), np.iinfo(np.int64).max)
        for first in range(0, len(centroids), CENTROIDS_AT_ONCE):
            some = centroids[first : first + CENTROIDS_AT_ONCE]
            distance = np.zeros((len(self.ids), len(some)), np.int64)
            for d, occurring in enumerate(self.values):
                table = (occurring[:, None] - some[None, :, d]) ** 2
                distance += table[self.codes[d]]
            best = distance.argmin(axis=1)
            found = distance[np.arange(len(best)), best]
            closer = found < least
            number[closer], least[closer] = best[closer] + first, found[closer]
        return number, least

    def sums(self, number: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Vectors and componentwise sums of each of k centroids."""
        order = np.argsort(number, kind="stable")
        present, first = np.unique(number[order], return_index=True)
        total = np.zeros((k, len(self.values)), np.int64)
        for d, occurring in enumerate(self.values):
            total[present, d] = np.add.reduceat(occurring[self.codes[d][order]], first)
        return np.bincount(number, minlength=k), total


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[Block]:
    for batch in batches:
        for row in batch.to_pylist():
            yield Block(row, size)


def starting_centroids(rows: DataFrame, k: int, salt: str) -> np.ndarray:
    """The k vectors with the smallest hashes of salt and id, in that order."""
    hashed = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    first = rows.where("vec_id is not null").select(hashed.alias("h"), "x").orderBy("h", "x").limit(k)
    return np.array([r.x for r in first.collect()], np.int64)


def moved(blocks: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """One round: the floor of each centroid's mean vector; centroids without vectors stay."""
    k, size = centroids.shape

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(k, np.int64), np.zeros((k, size), np.int64)
        for block in _blocks(batches, size):
            n, s = block.sums(block.nearest(centroids)[0], k)
            count += n
            total += s
        some = np.flatnonzero(count)
        if len(some):
            columns = {"cluster": pa.array(some, pa.int32()), "n": count[some]}
            yield pa.RecordBatch.from_pydict(columns | {f"s{d}": total[some, d] for d in range(size)})

    sums = [f"s{d}" for d in range(size)]
    parts = blocks.mapInArrow(local, "cluster int, n long, " + ", ".join(f"{s} long" for s in sums))
    added = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(s).alias(s) for s in sums])
    out = centroids.copy()
    for row in added.collect():  # at most k rows
        out[row.cluster] = [row[s] // row.n for s in sums]
    return out


def assigned(blocks: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of every vector."""
    size = centroids.shape[1]

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, size):
            number, distance = block.nearest(centroids)
            yield pa.RecordBatch.from_pydict(
                {"vec_id": pa.array(block.ids, mask=block.no_id), "cluster": pa.array(number, pa.int32()), "distance": distance}
            )

    return blocks.mapInArrow(local, "vec_id long, cluster int, distance long")


def clustered(vectors: DataFrame, k: int = 40, rounds: int = 5, size: int = 64, salt: str = "2:") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for the vectors (vec_id, embedding) of one length."""
    spark = vectors.sparkSession
    small_batches(spark)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), integers(F.col("embedding")).alias("x"))
    rows = written(rows.where(F.col("x").isNotNull() & (F.size("x") == size)), "integers")
    centroids = starting_centroids(rows, k, salt)
    if not len(centroids):
        # Nothing, or rows without id only: no centroid.
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    blocks = written(blocks_of(rows, size), "blocks")
    for _ in range(rounds):
        centroids = moved(blocks, centroids)
    result = written(assigned(blocks, centroids), "assigned")
    per_cluster = {r.cluster: r.d for r in result.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # at most k rows
    names = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    about = spark.createDataFrame(
        [(c, per_cluster.get(c, 0), sum(per_cluster.values()), name) for c, name in enumerate(names)],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string",
    )
    return result.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
