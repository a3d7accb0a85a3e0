"""Whitening of vectors: the leading principal components of their distinct integer vectors, each scaled to variance one.

A vector's entries c become x = floor(256 c), and each distinct x counts once (the fit list). Its sums are exact
integers; a second pass multiplies the centred vectors. A task emits one row of its partial matrix at a time, as bytes,
and these are added in two steps, so what reaches the driver is one matrix of size squared doubles. There it is brought
to tridiagonal form by Householder reflections; bisection on Sturm counts brackets each leading eigenvalue, inverse
iteration gives its vector, and vectors of eigenvalues that lie close together are made orthogonal to each other as they
arise. Mean and components, a few vectors, go to every task for the projection. The covariance of the projected fit list
is then measured the same way, as a check.

Defined results: null vectors and those with null or non-finite entries are dropped, empty vectors have no component and
no row; vectors of different lengths are whitened by length, each with its own fit list; rows of one id and rows without
id keep their own results; a component without variance has explained 0 and null as its whitened value, and is no part of
the identity error; ``deviation`` is null where it exceeds a long; an entry beyond 2^40 in size is an error; other columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import small_batches, written

SCALE = 256
# Sums of so large integers over 2^22 rows of a task stay exact in 64 bits.
LARGEST = 2**40
# The first of the two steps that add partial results.
SLOTS = 32
EPS = np.finfo(np.float64).eps
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def integers(vector: Column) -> Column:
    """floor(256 x) of each entry as a long; null for vectors that are null or hold null or non-finite entries."""
    whole = vector.cast("array<double>")
    finite = F.forall(whole, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    scaled = F.transform(whole, lambda x: F.floor(x * SCALE))
    return F.when(F.coalesce(finite, F.lit(False)), scaled)


def matrix(column: pa.Array) -> np.ndarray:
    """The rows of a list column of equal lengths."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


# ---- sums over all tasks ------------------------------------------------------------


def added(parts: DataFrame, dtype: str) -> dict[int, np.ndarray]:
    """i -> the sum of ``data`` over the rows (i, slot, data) of parts; one row for each i reaches the driver."""

    def add(rows: pa.Table) -> pa.Table:
        total = None
        for data in rows.column("data"):
            one = np.frombuffer(data.as_buffer(), dtype)
            total = one.copy() if total is None else total + one
        return pa.table({"i": rows.column("i")[:1], "slot": rows.column("slot")[:1], "data": pa.array([total.tobytes()], pa.binary())})

    schema = "i int, slot int, data binary"
    near = parts.groupBy("i", "slot").applyInArrow(add, schema).withColumn("slot", F.lit(0))
    return {r.i: np.frombuffer(r.data, dtype) for r in near.groupBy("i", "slot").applyInArrow(add, schema).collect()}


def with_slot(frame: DataFrame) -> DataFrame:
    return frame.withColumn("slot", F.spark_partition_id() % SLOTS).select("i", "slot", "data")


def count_and_sums(fit: DataFrame, size: int) -> tuple[int, np.ndarray]:
    """The number of vectors and their exact sums: 64-bit integers where all of ``n x`` and S fit, Python's elsewhere."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Low and high parts by themselves, so that no sum leaves 64 bits.
        low, high, n = np.zeros(size, np.int64), np.zeros(size, np.int64), 0
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(0))
                if np.abs(x).max() > LARGEST:
                    raise ValueError("an entry of a vector is too large to be whitened")
                low += (x & 0xFFFFF).sum(axis=0)
                high += (x >> 20).sum(axis=0)
                n += len(x)
        data = np.concatenate([low, high, [n]]).astype(np.int64).tobytes()
        yield pa.RecordBatch.from_pydict({"i": pa.array([0], pa.int32()), "data": pa.array([data], pa.binary())})

    total = added(with_slot(fit.select("x").mapInArrow(local, "i int, data binary")), "i8")[0]
    largest = fit.select(F.max(F.greatest(F.abs(F.array_max("x")), F.abs(F.array_min("x"))))).first()[0]
    n, sums = int(total[-1]), total[:size].astype(object) + total[size : 2 * size].astype(object) * 2**20
    return n, sums.astype(np.int64) if n * largest < 2**62 else sums


def covariance(fit: DataFrame, n: int, sums: np.ndarray) -> np.ndarray:
    """The covariance of the fit list, divisor n; the vectors are centred before they are multiplied."""
    size, mean = len(sums), (sums / n).astype(np.float64)  # of Python's integers, too, the nearest double

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            if batch.num_rows:
                centred = matrix(batch.column(0)) - mean
                total += centred.T @ centred
        for i, row in enumerate(total):
            yield pa.RecordBatch.from_pydict({"i": pa.array([i], pa.int32()), "data": pa.array([row.tobytes()], pa.binary())})

    rows = added(with_slot(fit.select("x").mapInArrow(local, "i int, data binary")), "f8")
    full = np.vstack([rows[i] for i in range(size)]) / n
    return (full + full.T) / 2


# ---- eigenvalues of a small symmetric matrix ------------------------------------------


def tridiagonal(symmetric: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(diagonal, off-diagonal, reflections) of Q' A Q; reflection k leaves the first k + 1 coordinates alone."""
    a = symmetric.astype(np.float64).copy()
    n = len(a)
    reflections = []
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        length = np.linalg.norm(v)
        v[0] += length if v[0] >= 0 else -length
        norm = np.linalg.norm(v)
        if length == 0 or norm == 0:
            reflections.append(np.zeros(n - k - 1))
            continue
        v /= norm
        below = a[k + 1 :, k + 1 :]
        p = below @ v
        w = p - (p @ v) * v
        below -= 2 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1 :, k] -= 2 * v * (v @ a[k + 1 :, k])
        a[k, k + 1 :] = a[k + 1 :, k]
        reflections.append(v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflections


def reflected(reflections: list[np.ndarray], vector: np.ndarray) -> np.ndarray:
    """Q v: a vector of the tridiagonal form back in the coordinates of the matrix."""
    out = vector.copy()
    for v in reversed(reflections):
        tail = out[len(out) - len(v) :]
        tail -= 2 * v * (v @ tail)
    return out


def count_below(diagonal: np.ndarray, off: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Sturm count: how many eigenvalues lie below each x, from the signs of the pivots of T - x."""
    tiny = np.finfo(np.float64).tiny / EPS
    squares = np.concatenate([[0.0], off**2])
    pivot, below = np.ones_like(x), np.zeros(x.shape, np.int64)
    for d, s in zip(diagonal, squares):
        pivot = d - x - s / pivot
        pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)
        below += pivot < 0
    return below


def leading_eigenvalues(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling: bisection until the bracket is as narrow as doubles allow."""
    n = len(diagonal)
    reach = np.zeros(n)
    reach[:-1] += np.abs(off)
    reach[1:] += np.abs(off)
    low = np.full(k, (diagonal - reach).min())
    high = np.full(k, (diagonal + reach).max())
    slack = EPS * max(1e-300, np.abs([low[0], high[0]]).max()) * n
    low, high = low - slack, high + slack
    # Eigenvalue number n - 1 - i, counted from the smallest, is below x just if more than that many are.
    rank = n - 1 - np.arange(k)
    for _ in range(200):
        middle = (low + high) / 2
        above = count_below(diagonal, off, middle) > rank
        low, high = np.where(above, low, middle), np.where(above, middle, high)
        if (high - low <= 2 * EPS * np.maximum(np.abs(low), np.abs(high))).all():
            break
    return (low + high) / 2


def _solved(diagonal: np.ndarray, off: np.ndarray, shift: float, right: np.ndarray) -> np.ndarray:
    """x with (T - shift) x = right: elimination with row exchanges; a pivot of zero becomes tiny."""
    n = len(diagonal)
    if n == 1:
        return right.copy()
    scale = max(np.abs(diagonal).max(), np.abs(off).max(), np.finfo(np.float64).tiny / EPS)
    d, upper = diagonal - shift, np.append(off, 0.0)
    second, x = np.zeros(n), right.astype(np.float64).copy()
    for i in range(n - 1):
        below = off[i]
        if abs(d[i]) >= abs(below):
            factor = below / d[i] if d[i] else 0.0
            d[i + 1] -= factor * upper[i]
            x[i + 1] -= factor * x[i]
        else:
            factor = d[i] / below
            d[i], upper[i], d[i + 1], second[i] = below, d[i + 1], upper[i] - factor * d[i + 1], upper[i + 1]
            upper[i + 1] = -factor * second[i]
            x[i], x[i + 1] = x[i + 1], x[i] - factor * x[i + 1]
    d = np.where(np.abs(d) < EPS * scale, EPS * scale, d)
    x[n - 1] /= d[n - 1]
    x[n - 2] = (x[n - 2] - upper[n - 2] * x[n - 1]) / d[n - 2]
    for i in range(n - 3, -1, -1):
        x[i] = (x[i] - upper[i] * x[i + 1] - second[i] * x[i + 2]) / d[i]
    return x


def inverse_iteration(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A unit vector for each eigenvalue (falling). Vectors of a cluster are made orthogonal in every step."""
    n, span = len(diagonal), max(np.abs(diagonal).max(), np.abs(off).max() if len(off) else 0.0)
    rng = np.random.default_rng(0)
    vectors: list[np.ndarray] = []
    first = 0  # of the cluster
    shift = None
    for i, value in enumerate(values):
        if i and values[i - 1] - value > 1e-3 * span:
            first = i
        # Equal eigenvalues get shifts that differ a little.
        shift = value if i == first else min(value, shift - 10 * EPS * span)
        vector = rng.standard_normal(n)
        for _ in range(6):
            vector = _solved(diagonal, off, shift, vector)
            vector /= np.abs(vector).max()
            for _ in range(2):
                for other in vectors[first:]:
                    vector = vector - (other @ vector) * other
            vector /= np.linalg.norm(vector)
        vectors.append(vector)
    return np.array(vectors)


def leading_components(symmetric: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors): the k largest eigenvalues, falling, and their unit vectors as rows."""
    k = min(k, len(symmetric))
    # One part of 1 at most, so that no square leaves the range of doubles.
    scale = np.abs(symmetric).max() or 1.0
    diagonal, off, reflections = tridiagonal(symmetric / scale)
    values = leading_eigenvalues(diagonal, off, k)
    vectors = np.array([reflected(reflections, v) for v in inverse_iteration(diagonal, off, values)])
    return values * scale, vectors


# ---- the whole ------------------------------------------------------------------------


def _gaps(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n x - S, exact."""
    return x.astype(sums.dtype) * n - sums


def _deviations(gap: np.ndarray) -> list[int | None]:
    """The exact sum of squares of each row; None beyond a long."""
    about = (gap.astype(np.float64) ** 2).sum(axis=1)
    out: list[int | None] = [None] * len(gap)
    small = np.flatnonzero(about < 2**62)
    for i, total in zip(small.tolist(), (gap[small].astype(np.int64) ** 2).sum(axis=1).tolist()):
        out[i] = total
    for i in np.flatnonzero((about >= 2**62) & (about < 2**63 * 1.001)).tolist():
        total = sum(int(g) ** 2 for g in gap[i])
        out[i] = total if total < 2**63 else None
    return out


def _projected(gap: np.ndarray, n: int, components: np.ndarray, values: np.ndarray) -> np.ndarray:
    """(rows, components): the whitened values of vectors whose ``_gaps`` these are."""
    return (gap / n).astype(np.float64) @ components.T / np.sqrt(values)


def identity_error(fit: DataFrame, n: int, sums: np.ndarray, components: np.ndarray, values: np.ndarray) -> float | None:
    """The largest absolute entry of the covariance of the whitened fit list minus the identity."""
    k = len(values)
    if not k:
        return None

    def sums_of(moment):
        def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = 0.0
            for batch in batches:
                if batch.num_rows:
                    total = total + moment(_projected(_gaps(matrix(batch.column(0)), n, sums), n, components, values))
            if not np.isscalar(total):
                yield pa.RecordBatch.from_pydict({"i": pa.array([0], pa.int32()), "data": pa.array([total.tobytes()], pa.binary())})

        return added(with_slot(fit.select("x").mapInArrow(local, "i int, data binary")), "f8")[0] / n

    mean = sums_of(lambda y: y.sum(axis=0))
    spread = sums_of(lambda y: (y - mean).T @ (y - mean)).reshape(k, k)
    return float(np.abs(spread - np.eye(k)).max())


def _of_length(rows: DataFrame, fit: DataFrame, size: int, k: int) -> DataFrame:
    n, sums = count_and_sums(fit, size)
    spread = covariance(fit, n, sums)
    values, components = leading_components(spread, k)
    trace = float(np.trace(spread))
    alive = values > trace * size * EPS * 16
    error = identity_error(fit, n, sums, components[alive], values[alive])
    explained = np.where(alive, values, 0.0) / (trace or 1.0)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows_here, many = batch.num_rows, len(values)
            if not rows_here:
                continue
            gap = _gaps(matrix(batch.column(1)), n, sums)
            deviation = _deviations(gap)
            whitened = np.full((rows_here, many), np.nan)
            whitened[:, alive] = _projected(gap, n, components[alive], values[alive])
            spots = np.repeat(np.arange(rows_here), many)
            yield pa.RecordBatch.from_pydict(
                {
                    "vec_id": batch.column(0).take(pa.array(spots)),
                    "component": pa.array(np.tile(np.arange(1, many + 1), rows_here), pa.int32()),
                    "n": np.full(len(spots), n, np.int64),
                    "deviation": pa.array(deviation, pa.int64()).take(pa.array(spots)),
                    "whitened": pa.array(whitened.ravel(), pa.float64(), mask=np.isnan(whitened.ravel())),
                    "explained": np.tile(explained, rows_here),
                    "identity_error": pa.array([error] * len(spots), pa.float64()),
                }
            )

    return rows.select("vec_id", "x").mapInArrow(project, RESULT)


def whitened(vectors: DataFrame, components: int = 4) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for rows of vectors (vec_id, embedding)."""
    spark = vectors.sparkSession
    small_batches(spark)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), integers(F.col("embedding")).alias("x"))
    rows = written(rows.where("x is not null and size(x) > 0"), "integers")
    # Equal vectors are one before the shuffle as well, so copies of a third of all rows are few.
    fit = written(rows.select("x").distinct(), "fit")
    sizes = sorted(r[0] for r in fit.select(F.size("x")).distinct().collect())
    parts = [_of_length(rows.where(F.size("x") == s), fit.where(F.size("x") == s), s, components) for s in sizes]
    out = spark.createDataFrame([], RESULT)
    for i, part in enumerate(parts):
        out = part if not i else out.unionByName(part)
    return out
