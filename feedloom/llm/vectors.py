"""Near duplicates of vectors by cosine: tiles in PCA order, leading dimensions first, the rest bounded.

Equal vectors are one node. The unit vectors are turned into the basis of their second moments, most of the
length first, range-partitioned by the leading coordinate and cut into blocks, which are written. A task takes a block and
reads, one at a time, the blocks whose leading coordinates are near enough; only names of blocks are shuffled. There, tile
by tile, the product of the leading dimensions plus the product of the norms of the rest bounds every cosine from above;
pairs whose bound reaches the threshold get the next dimensions, step by step, until the bound falls below it or all are in.
A task returns one count for each of its vectors, the forest of links inside its block, and for another block the
distinct pairs of trees that are linked, never pairs of vectors, so a large group of near copies costs products but no
rows. Comparing all pairs remains quadratic in blocks: pruning lowers the cost of a pair, the window that of distant blocks.

Defined results: null or empty vectors, those with null or non-finite parts, and zero vectors link with nothing, keep
their row and are their own component; vectors of different lengths never link; rows of one id are
vectors of their own that are told apart by their values; rows without id link with nothing; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.llm.common import connected_components, new_folder, read_part, small_batches, written
from feedloom.llm.whitening import added, with_slot

BLOCK_ROWS = 4096
TILE_ROWS = 1024
# Dimensions after which a pair is looked at again.
STEPS = (16, 24, 32, 48)
# Tasks that compare blocks, at most; a task takes several blocks beyond.
MOST_TASKS = 20_000
# Bounds are computed in single precision; this is far above its error and below any gap that matters.
SLACK = 1e-4


def usable(vector: Column) -> Column:
    """False for vectors that link with nothing."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _unit(matrix: np.ndarray) -> np.ndarray:
    # The largest part first, so that tiny and huge vectors keep their direction.
    matrix = matrix / np.abs(matrix).max(axis=1, keepdims=True)
    return matrix / np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))


def principal_axes(nodes: DataFrame, size: int) -> np.ndarray:
    """(size, size): the axes of the unit vectors' second moments, longest first. Only sums reach the driver."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            if batch.num_rows:
                unit = _unit(_matrix(batch.column(0)))
                total += unit.T @ unit
        for i, row in enumerate(total):
            yield pa.RecordBatch.from_pydict({"i": pa.array([i], pa.int32()), "data": pa.array([row.tobytes()], pa.binary())})

    rows = added(with_slot(nodes.select("vector").mapInArrow(moments, "i int, data binary")), "f8")
    values, axes = np.linalg.eigh(np.vstack([rows[i] for i in range(size)]))
    return axes[:, ::-1]


def _blocks(nodes: DataFrame, axes: np.ndarray, block_rows: int, threshold: float) -> str:
    """A folder of blocks of neighbouring leading coordinates: block=<b> has ids, weights, data, links and roots.

    ``links`` and ``roots`` are the counts and the forest of the links inside the block.
    """
    size = axes.shape[0]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                turned = _unit(_matrix(batch.column(2))) @ axes
                yield pa.RecordBatch.from_pydict(
                    {"vec_id": batch.column(0), "copies": batch.column(1), "lead": turned[:, 0].copy(), "data": pa.array([r.tobytes() for r in turned], pa.binary())}
                )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(rows):
            ids, copies, lead, data = zip(*rows)
            own = np.frombuffer(b"".join(data), np.float64).reshape(-1, size)
            weights = np.array(copies, np.int64)
            links, _, roots, _ = compare(own, own, True, weights, weights, threshold)
            return pa.RecordBatch.from_pydict(
                {
                    "links": pa.array([links.tobytes()], pa.binary()),
                    "roots": pa.array([roots.tobytes()], pa.binary()),
                    "low": [lead[0]],
                    "high": [lead[-1]],
                    "ids": pa.array([np.array(ids, np.int64).tobytes()], pa.binary()),
                    "weights": pa.array([np.array(copies, np.int64).tobytes()], pa.binary()),
                    "data": pa.array([b"".join(data)], pa.binary()),
                }
            )

        held: list[tuple] = []
        for batch in batches:
            held += zip(*(c.to_pylist() for c in batch.columns))
            while len(held) >= block_rows:
                yield block(held[:block_rows])
                held = held[block_rows:]
        if held:
            yield block(held)

    turned = nodes.select("vec_id", "copies", "vector").mapInArrow(project, "vec_id long, copies long, lead double, data binary")
    turned = written(turned, "turned")
    parts = max(1, -(-turned.count() // block_rows))
    # Sampled splitters; equal coordinates stay together, and a partition is cut into as many blocks as it fills.
    ordered = turned.repartitionByRange(parts, "lead").sortWithinPartitions("lead")
    cuts = ordered.mapInArrow(cut, "links binary, roots binary, low double, high double, ids binary, weights binary, data binary")
    folder = new_folder(nodes.sparkSession, "blocks")
    cuts.withColumn("block", F.monotonically_increasing_id()).write.partitionBy("block").parquet(folder)
    return folder


def _roots(n: int, i: np.ndarray, j: np.ndarray, roots: np.ndarray) -> np.ndarray:
    """roots with the links (i, j) joined in; roots[x] <= x."""
    while True:
        a, b = roots[i], roots[j]
        apart = a != b
        if not apart.any():
            return roots
        np.minimum.at(roots, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while True:
            up = roots[roots]
            if (up == roots).all():
                break
            roots = up


def _linked(a: np.ndarray, b: np.ndarray, upper: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of the linked pairs of two tiles of turned unit vectors, with ``upper`` those of i < j."""
    size = a.shape[1]
    steps = [s for s in STEPS if s < size] + [size]

    def rest(x: np.ndarray, done: int) -> np.ndarray:
        return np.sqrt(np.maximum(0, 1 - (x[:, :done] ** 2).sum(axis=1)))

    done = steps[0]
    left, right = (np.column_stack([x[:, :done], rest(x, done)]).astype(np.float32) for x in (a, b))
    near = left @ right.T >= threshold - SLACK
    if upper:
        near = np.triu(near, 1)
    i, j = np.nonzero(near)
    if len(i) * 16 > near.size:
        found = (a @ b.T)[i, j] >= threshold
        return i[found], j[found]
    # Few pairs are left: they go on alone.
    out = []
    for s in range(0, len(i), 65_536):
        p, q = i[s : s + 65_536], j[s : s + 65_536]
        product = np.einsum("ij,ij->i", a[p, :done], b[q, :done])
        for last, step in zip(steps, steps[1:]):
            product = product + np.einsum("ij,ij->i", a[p, last:step], b[q, last:step])
            stay = product + rest(a, step)[p] * rest(b, step)[q] >= threshold - SLACK
            p, q, product = p[stay], q[stay], product[stay]
            if not len(p):
                break
        whole = np.einsum("ij,ij->i", a[p], b[q]) >= threshold
        out.append((p[whole], q[whole]))
    return tuple(np.concatenate(x) if out else np.zeros(0, np.int64) for x in (zip(*out) if out else ((), ())))


def compare(a: np.ndarray, b: np.ndarray, same: bool, wa: np.ndarray, wb: np.ndarray, threshold: float, trees: tuple | None = None):
    """Links of two blocks: weighted counts for a and b, roots inside a block that meets itself, linked pairs of ``trees``.

    ``trees`` are the roots of both blocks; without them no pairs are returned.
    """
    na, nb = len(a), len(b)
    la, lb = np.zeros(na, np.int64), np.zeros(nb, np.int64)
    roots, pairs = np.arange(na), set()
    for p in range(0, na, TILE_ROWS):
        for q in range(p if same else 0, nb, TILE_ROWS):
            i, j = _linked(a[p : p + TILE_ROWS], b[q : q + TILE_ROWS], same and p == q, threshold)
            if not len(i):
                continue
            i, j = i + p, j + q
            la += np.bincount(i, wb[j], na).astype(np.int64)
            lb += np.bincount(j, wa[i], nb).astype(np.int64)
            if same:
                roots = _roots(na, i, j, roots)
            if trees is not None:
                met = np.unique(trees[0][i] * nb + trees[1][j])
                pairs.update(zip((met // nb).tolist(), (met % nb).tolist()))
    return (la + lb if same else la), lb, roots, pairs


def near_vectors(vectors: DataFrame, threshold: float = 0.95, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors (vec_id, embedding)."""
    spark = vectors.sparkSession
    small_batches(spark)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    rows = rows.withColumn("usable", usable(F.col("vector")) & F.col("vec_id").isNotNull())
    # Minus zero equals zero here.
    key = F.when(F.col("usable"), F.sha2(F.array_join(F.transform("vector", lambda x: (x + 0.0).cast("string")), ","), 256))
    rows = rows.withColumn("key", key)
    nodes = rows.where("usable").groupBy("key").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"), F.first("vector").alias("vector"))
    nodes = written(nodes, "nodes")
    links = edges = None
    sizes = sorted(r[0] for r in nodes.select(F.size("vector")).distinct().collect())
    for size in sizes:
        own = nodes.where(F.size("vector") == size)
        folder = _blocks(own, principal_axes(own, size), block_rows, threshold)
        found = written(_block_links(spark, folder, size, threshold), "found")
        one = found.where("kind = 0").select(F.col("a").alias("vec_id"), F.col("b").alias("n"))
        two = found.where("kind = 1").select(F.col("a").alias("u"), F.col("b").alias("v"))
        links, edges = (one, two) if links is None else (links.unionByName(one), edges.unionByName(two))
    base = rows.select("vec_id", "key")
    if links is None:
        return base.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    components = connected_components(edges).withColumnRenamed("node", "vec_id")
    counted = links.groupBy("vec_id").agg(F.sum("n").alias("n"))
    classes = nodes.select("key", "vec_id", "copies").join(counted, "vec_id", "left").join(components, "vec_id", "left").select(
        "key", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id")
    )
    out = base.join(written(classes, "classes"), "key", "left")
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _block_links(spark: SparkSession, folder: str, size: int, threshold: float) -> DataFrame:
    """(kind, a, b): 0, a vector and its links; 1, an edge of two vectors."""
    # |u - v|^2 = 2 - 2 cos bounds the distance along the leading axis.
    reach = (2 - 2 * threshold) ** 0.5 + 1e-9
    names = new_folder(spark, "block-names")
    spark.read.parquet(folder).select("block", "low", "high").write.parquet(names)
    blocks = spark.read.parquet(names)
    # So many tasks on purpose: a row is a whole block's work.
    dealt = blocks.repartition(max(1, min(blocks.count(), MOST_TASKS)))

    def load(block: int) -> tuple[np.ndarray, ...]:
        row = read_part(folder, f"block={block}", ["ids", "weights", "data", "links", "roots"]).to_pylist()[0]
        ids, weights, links, roots = (np.frombuffer(row[c], np.int64) for c in ("ids", "weights", "links", "roots"))
        return ids, weights, np.frombuffer(row["data"], np.float64).reshape(-1, size), links, roots

    def rows(kind: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"kind": pa.array(np.full(len(a), kind), pa.int32()), "a": a, "b": b})

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for mine in batch.to_pylist():
                ids, weights, data, links, roots = load(mine["block"])
                links = links.copy()
                moved = np.flatnonzero(roots != np.arange(len(roots)))
                yield rows(1, ids[moved], ids[roots[moved]])
                near = [("low", "<=", mine["high"] + reach), ("high", ">=", mine["low"] - reach)]
                for other in read_part(names, "", ["block", "low", "high"], near)["block"].to_pylist():
                    if other == mine["block"]:
                        continue
                    ids_b, weights_b, data_b, _, roots_b = load(other)
                    # Counts are of the task's own vectors; an edge is found by the task of the earlier block.
                    trees = (roots, roots_b) if mine["block"] < other else None
                    more, _, _, pairs = compare(data, data_b, False, weights, weights_b, threshold, trees)
                    links += more
                    if pairs:
                        i, j = (np.array(x) for x in zip(*pairs))
                        yield rows(1, ids[i], ids_b[j])
                some = np.flatnonzero(links)
                yield rows(0, ids[some], links[some])

    return dealt.mapInArrow(link, "kind int, a long, b long")
