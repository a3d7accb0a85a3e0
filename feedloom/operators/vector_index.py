"""Inverted cells over stored vectors: a search reads the cells that can hold a hit.

Centroids are fitted on a bounded sample (``sample_rows``, by the least hashes of the keys); every row is then assigned
to its nearest centroid and written under its cell, with the cells' radii beside. Vectors are compared as points of the unit sphere, where
|q - x|^2 = 2 - 2 cos. A point x of a cell with centroid c and radius r is no nearer to q than |q - c| - r, which bounds
every cosine of the cell from above.

A search probes the nearest cells of each query first. The exact mode then reads each further cell whose bound reaches the
query's k-th score so far, so nothing is lost whatever the cells look like; the probing mode stops after the first pass, and
``probes_for`` finds the number of cells that reaches a wanted recall, measured against the exact mode. Zero vectors and
vectors of another length than most are in a cell of their own that every query reads, and a query of another length
reads all cells.

Which queries read which cell is written as one bitmap for each cell and block of queries, so a task takes the bitmaps of
the cells it has and the blocks of queries from the shared folder, and a cell of a third of all rows is many tasks.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom.functions.vectors import has_vector, rows_by_length
from feedloom.operators import search
from feedloom.operators.ranking import top_k_per_group
from feedloom.session import shared_dir

# The cell of vectors that have no place on the sphere of the others.
OUTSIDE = -1
# Rows of the sample that centroids are fitted on, and rounds of the fit.
SAMPLE_ROWS = 20_000
ROUNDS = 8
MOST_CELLS = 4_096
# Rounding of distances, far below any gap that matters.
SLACK = 1e-6


@dataclass(frozen=True)
class VectorIndex:
    """A written index: ``folder``/rows/cell=<c> has the keys and vectors."""

    folder: str
    keys: tuple[str, ...]
    centroids: np.ndarray
    radii: np.ndarray
    schema: T.StructType

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(self.schema).parquet(f"{self.folder}/rows")


def _unit(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(unit rows, whether they have a length)."""
    largest = np.abs(matrix).max(axis=1, keepdims=True)
    ok = (largest[:, 0] > 0) & np.isfinite(largest[:, 0])
    scaled = np.divide(matrix, largest, out=np.zeros_like(matrix), where=ok[:, None])
    norms = np.linalg.norm(scaled, axis=1, keepdims=True)
    return np.divide(scaled, norms, out=np.zeros_like(scaled), where=ok[:, None]), ok


def fitted_centroids(points: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means of unit points; the points come in random order, and the first ones are the start."""
    _, first = np.unique(points.round(6), axis=0, return_index=True)
    centroids = points[np.sort(first)[:cells]]
    for _ in range(rounds):
        place = (points @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, place, points)
        moved, ok = _unit(sums)
        centroids = np.where(ok[:, None], moved, centroids)
    return centroids


def build_index(
    items: DataFrame, keys: Sequence[str] = ("source_id",), cells: int | None = None, sample_rows: int = SAMPLE_ROWS, folder: str | None = None
) -> VectorIndex:
    """Assign every row of items (keys, embedding) that has a vector to a cell and write it there."""
    spark = items.sparkSession
    folder = folder or f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    rows = items.filter(has_vector("embedding")).select(*keys, "embedding")
    # The cell is a folder's name, so it is read last.
    more = [T.StructField("far", T.DoubleType()), T.StructField("cell", T.IntegerType())]
    schema = T.StructType([*rows.schema.fields, *more])
    by_size = rows.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), "size").first()
    if by_size is None:
        spark.createDataFrame([], schema).write.parquet(f"{folder}/rows")
        return VectorIndex(folder, tuple(keys), np.zeros((0, 1)), np.zeros(0), schema)
    size = by_size.size
    some = rows.filter(F.size("embedding") == size).select("embedding", F.xxhash64(*keys).alias("h")).orderBy("h").limit(sample_rows)
    points, ok = _unit(np.array([r.embedding for r in some.collect()], np.float64))  # at most ``sample_rows``
    points = points[ok]
    wanted = cells or int(min(MOST_CELLS, max(1, by_size["count"] ** 0.5)))
    centroids = fitted_centroids(points, wanted) if len(points) else np.zeros((0, size))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(batch.schema.get_field_index("embedding"))
            cell, far = np.full(batch.num_rows, OUTSIDE, np.int32), np.zeros(batch.num_rows)
            for at, matrix in rows_by_length(vectors):
                if matrix.shape[1] == size and len(centroids):
                    unit, ok = _unit(matrix)
                    best = (unit @ centroids.T).argmax(axis=1)
                    cell[at] = np.where(ok, best, OUTSIDE)
                    far[at] = np.where(ok, np.linalg.norm(unit - centroids[best], axis=1), 0.0)
            yield batch.append_column("far", pa.array(far)).append_column("cell", pa.array(cell))

    placed = rows.mapInArrow(assign, schema)
    # AQE splits a large cell over several files and joins small ones in a task.
    placed.hint("rebalance", "cell").sortWithinPartitions("cell", *keys).write.partitionBy("cell").parquet(f"{folder}/rows")
    stored = spark.read.schema(schema).parquet(f"{folder}/rows").groupBy("cell").agg(F.max("far").alias("radius")).collect()  # a row per cell
    radii = np.full(len(centroids), -1.0)
    for r in stored:
        if r.cell != OUTSIDE:
            radii[r.cell] = r.radius
    return VectorIndex(folder, tuple(keys), centroids, radii, schema)


# ---- which query reads which cell ---------------------------------------------------


def _planned(index: VectorIndex, block: pa.Table, probes: int, floor: np.ndarray | None) -> dict[int, np.ndarray]:
    """cell -> which queries of a block read it: the nearest cells, or with ``floor`` the others that can reach it."""
    n, cells = block.num_rows, len(index.centroids)
    near = np.zeros((cells, n), bool)
    able = np.ones((cells, n), bool)
    for at, matrix in rows_by_length(block["embedding"].combine_chunks()):
        unit, ok = _unit(matrix)
        if not cells or matrix.shape[1] != index.centroids.shape[1]:
            near[:, at] = True
            continue
        distance = np.linalg.norm(index.centroids, axis=1)[:, None] ** 2 + 1 - 2 * (index.centroids @ unit.T)
        distance = np.sqrt(np.maximum(distance, 0))
        distance[index.radii < 0] = np.inf
        first = np.argsort(distance, axis=0, kind="stable")[:probes]
        own = np.zeros_like(distance, bool)
        np.put_along_axis(own, first, True, axis=0)
        # A query without a length has cosine 0 with everything.
        own[:, ~ok] = True
        near[:, at] = own
        gap = np.maximum(0.0, distance - index.radii[:, None] - SLACK)
        bound = 1 - gap**2 / 2 + SLACK
        if floor is not None:
            able[:, at] = bound >= floor[at]
    filled = index.radii >= 0
    wanted = near if floor is None else able & ~near
    out = {c: wanted[c] for c in np.flatnonzero(filled & wanted.any(axis=1)).tolist()}
    if floor is None:
        out[OUTSIDE] = np.ones(n, bool)
    return out


def _write_plan(index: VectorIndex, queries: DataFrame, probes: int, floored: bool, folder: str) -> list[int]:
    """Write the bitmaps (cell, block, bits) and return the cells that are read."""

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for block in np.unique(table["block"].to_numpy()).tolist():
                own = table.filter(pc.equal(table["block"], block)).sort_by("number")
                floor = np.nan_to_num(own["floor"].to_numpy(), nan=-np.inf) if floored else None
                for cell, bits in _planned(index, own, probes, floor).items():
                    data = np.zeros(search.QUERIES_AT_ONCE, bool)
                    data[own["number"].to_numpy()[bits] % search.QUERIES_AT_ONCE] = True
                    yield pa.RecordBatch.from_pydict({"cell": pa.array([cell], pa.int32()), "block": pa.array([block], pa.int64()), "bits": pa.array([np.packbits(data).tobytes()], pa.binary())})

    found = queries.mapInArrow(plan, "cell int, block long, bits binary")
    # The bitmaps of one block may come from several tasks.
    found.repartition("cell").write.partitionBy("cell").parquet(folder)
    spark = queries.sparkSession
    return sorted(r[0] for r in spark.read.schema("block long, bits binary, cell int").parquet(folder).select("cell").distinct().collect())


def _bitmaps(folder: str, cell: int) -> dict[int, np.ndarray]:
    """block -> the queries of it that read a cell."""
    system, root = fs.FileSystem.from_uri(f"{folder}/cell={cell}")
    out: dict[int, np.ndarray] = {}
    for info in system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
        if info.path.endswith(".parquet"):
            with system.open_input_file(info.path) as source:
                for row in pq.read_table(source, columns=["block", "bits"]).to_pylist():
                    bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8)).astype(bool)
                    out[row["block"]] = out.get(row["block"], np.zeros(len(bits), bool)) | bits
    return out


def _block(folder: str, block: int) -> pa.Table:
    """The queries of a block by number."""
    system, root = fs.FileSystem.from_uri(f"{folder}/block={block}")
    parts = []
    for info in system.get_file_info(fs.FileSelector(root)):
        if info.path.endswith(".parquet"):
            with system.open_input_file(info.path) as source:
                parts.append(pq.read_table(source, columns=["number", "query_id", "embedding"]))
    return pa.concat_tables(parts).sort_by("number")


def _scan(index: VectorIndex, spark: SparkSession, cells: list[int], plan: str, queries: str, query_type: T.DataType, k: int) -> DataFrame:
    """The best rows of the cells for the queries that read them, at most k for a task and query."""
    keys = list(index.keys)
    rows = index.rows(spark).filter(F.col("cell").isin(cells)).select(*keys, "embedding", F.col("cell").cast("int").alias("cell"))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = search.BestPerQuery(keys, k)
        bitmaps: dict[int, dict[int, np.ndarray]] = {}
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for cell in np.unique(table["cell"].to_numpy()).tolist():
                if cell not in bitmaps:
                    bitmaps = {cell: _bitmaps(plan, cell)}
                own = table.filter(pc.equal(table["cell"], cell)).sort_by([(c, "ascending") for c in keys])
                for number, bits in bitmaps[cell].items():
                    block = _block(queries, number)
                    block = block.filter(pa.array(bits[block["number"].to_numpy() % len(bits)]))
                    yield from kept.add(number, own, block)
        yield from kept.flush()

    schema = T.StructType([rows.schema[c] for c in keys] + [T.StructField("query_id", query_type), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(best, schema)


def search_indexed(index: VectorIndex, queries: DataFrame, k: int = 20, probes: int = 4, exact: bool = True) -> DataFrame:
    """Top ``k`` rows (keys, score, rank) for each of queries (query_id, embedding); query_id is unique."""
    spark, keys = queries.sparkSession, list(index.keys)
    root = f"{shared_dir(spark)}/asked-{uuid.uuid4().hex}"
    order = [F.col("score").desc(), *map(F.col, keys)]
    asked = queries.filter(has_vector("embedding")).select("query_id", F.col("embedding").cast("array<double>"))
    # Numbered inside partitions, so a block is 256 queries of one partition at most.
    number = F.monotonically_increasing_id()
    asked.withColumn("number", number).withColumn("block", F.expr(f"number div {search.QUERIES_AT_ONCE}")).write.partitionBy("block").parquet(f"{root}/queries")
    schema = T.StructType([*asked.schema.fields, T.StructField("number", T.LongType()), T.StructField("block", T.LongType())])
    stored = spark.read.schema(schema).parquet(f"{root}/queries")
    kind = queries.schema["query_id"].dataType
    cells = _write_plan(index, stored.repartition("block"), probes, False, f"{root}/first")
    found = _scan(index, spark, cells, f"{root}/first", f"{root}/queries", kind, k)
    found = top_k_per_group(found, ["query_id"], order, k)
    if not exact:
        return found
    found.drop("rank").write.parquet(f"{root}/found")
    found = spark.read.schema(found.drop("rank").schema).parquet(f"{root}/found")
    kth = found.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
    floored = stored.join(kth, "query_id", "left").repartition("block")
    cells = _write_plan(index, floored, probes, True, f"{root}/second")
    more = _scan(index, spark, cells, f"{root}/second", f"{root}/queries", kind, k)
    return top_k_per_group(found.unionByName(more.select(*found.columns)), ["query_id"], order, k)


def recall(index: VectorIndex, queries: DataFrame, k: int, probes: int) -> float:
    """The share of the exact top k that the probing mode finds."""
    keys = ["query_id", *index.keys]
    want = search_indexed(index, queries, k)
    have = search_indexed(index, queries, k, probes, exact=False)
    total = want.count()
    return want.join(have.select(*keys), keys, "left_semi").count() / total if total else 1.0


def probes_for(index: VectorIndex, queries: DataFrame, k: int, wanted: float = 0.9) -> tuple[int, float]:
    """(probes, recall): the least power of two of cells whose measured recall for these queries is ``wanted``."""
    probes = 1
    while (reached := recall(index, queries, k, probes)) < wanted and probes < len(index.centroids):
        probes *= 2
    return probes, reached
