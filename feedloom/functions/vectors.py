"""Vector similarity."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from feedloom.functions.text import as_column

# Scores are compared at this many decimals, so equal vectors tie exactly.
SCORE_DIGITS = 12


def parse_vector_json(col: Column | str) -> Column:
    """JSON text to a float array; unreadable text gives NULL."""
    return F.from_json(as_column(col), "array<float>")


def has_vector(col: Column | str) -> Column:
    return F.coalesce(F.size(as_column(col)) > 0, F.lit(False))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def cosine_similarity(a: Column | str, b: Column | str) -> Column:
    """Cosine of two array columns, in the JVM.

    The dot product runs over the shorter length and the norms over the whole
    vectors; a zero norm gives 0.
    """
    x = as_column(a).cast("array<double>")
    y = as_column(b).cast("array<double>")
    n = F.least(F.size(x), F.size(y))
    dot = _dot(F.slice(x, 1, n), F.slice(y, 1, n))
    norms = F.sqrt(_dot(x, x)) * F.sqrt(_dot(y, y))
    return F.when(norms == 0, F.lit(0.0)).otherwise(F.try_divide(dot, norms))


def rows_by_length(vectors: pa.Array):
    """Yield (row numbers, float64 matrix) for each vector length in an Arrow list array."""
    lengths = np.asarray(vectors.value_lengths().fill_null(0))
    values = np.asarray(vectors.flatten(), dtype=np.float64)
    ends = np.cumsum(lengths)
    for length in np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero(lengths == length)
        if len(rows) == len(lengths):
            yield rows, values.reshape(-1, length)
        else:
            starts = ends[rows] - length
            yield rows, values[starts[:, None] + np.arange(length)]


def cosine_matrix(items: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Cosine of every item row with every query row (numpy, inside a task)."""
    n = min(items.shape[1], queries.shape[1])
    dots = items[:, :n] @ queries[:, :n].T
    norms = np.linalg.norm(items, axis=1)[:, None] * np.linalg.norm(queries, axis=1)[None, :]
    return np.divide(dots, norms, out=np.zeros_like(dots), where=norms != 0)


def cosine_to(query: Sequence[float], col: Column | str) -> Column:
    """Cosine of an array column with one fixed vector, in Arrow batches."""
    target = np.asarray([query], dtype=np.float64)

    @F.arrow_udf("double")
    def score(vectors: pa.Array) -> pa.Array:
        out = np.zeros(len(vectors))
        for rows, matrix in rows_by_length(vectors):
            out[rows] = cosine_matrix(matrix, target)[:, 0]
        return pa.array(out)

    return score(as_column(col))
