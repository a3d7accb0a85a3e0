"""Filtered cosine top-k over stored items."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from datetime import datetime
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom.functions.answers import list_or_empty
from feedloom.functions.times import days_before
from feedloom.functions.vectors import SCORE_DIGITS, cosine_matrix, cosine_to, has_vector, rows_by_length
from feedloom.operators.inference import EmbeddingProvider, call_with_retry
from feedloom.operators.ranking import top_k_per_group
from feedloom.session import shared_dir

# Items and queries that a task multiplies at once; both only bound its memory.
ITEMS_AT_ONCE = 16_384
QUERIES_AT_ONCE = 256
# Hits that a task holds at once.
BEST_ROWS = 4_000_000


# The names of the four filters.
@dataclass(frozen=True)
class SearchFilters:
    topics: Sequence[str] | None = None
    sentiment: int | None = None
    stance: str | None = None
    since_days: int | None = None


def any_topic(topics: Sequence[str], col: Column | str = "topics") -> Column:
    wanted = F.array(*map(F.lit, topics))
    return F.coalesce(F.arrays_overlap(list_or_empty(col), wanted), F.lit(False))


def predicate(filters: SearchFilters | None, as_of: datetime | None = None) -> Column:
    """One condition out of the filters that are set.

    Sentiment 0 is a value; an empty stance, 0 days and an empty topic list
    mean no filter. The recency bound is inclusive.
    """
    clauses = [F.lit(True)]
    if filters is not None:
        if filters.sentiment is not None:
            clauses.append(F.col("sentiment") == filters.sentiment)
        if filters.stance:
            clauses.append(F.col("stance") == filters.stance)
        if filters.since_days:
            if as_of is None:
                raise ValueError("a recency filter needs as_of")
            clauses.append(F.col("published_at") >= F.lit(days_before(as_of, filters.since_days)))
        if filters.topics:
            clauses.append(any_topic(filters.topics))
    return reduce(and_, clauses)


def searchable(items: DataFrame, filters: SearchFilters | None = None, as_of: datetime | None = None) -> DataFrame:
    return items.filter(predicate(filters, as_of) & has_vector("embedding"))


def semantic_search(
    items: DataFrame,
    query_vector: Sequence[float],
    filters: SearchFilters | None = None,
    limit: int = 20,
    as_of: datetime | None = None,
    tie_break: Sequence[str] = ("source_id",),
) -> DataFrame:
    """The ``limit`` best items with their ``score``, best first."""
    scored = searchable(items, filters, as_of).withColumn(
        "score", F.round(cosine_to(query_vector, "embedding"), SCORE_DIGITS)
    )
    return scored.orderBy(F.col("score").desc(), *tie_break).limit(limit)


def search_by_text(
    items: DataFrame,
    query: str,
    embedder: Callable[[], EmbeddingProvider],
    filters: SearchFilters | None = None,
    limit: int = 20,
    as_of: datetime | None = None,
) -> DataFrame:
    """``semantic_search`` for a text: the one query is embedded on the driver."""
    vector = call_with_retry(lambda: embedder().embed([query]))[0]
    return semantic_search(items, [float(x) for x in vector], filters, limit, as_of)


def search_result_view(hits: DataFrame) -> DataFrame:
    """What a user sees of a hit."""
    return hits.select(
        F.concat_ws(":", "source", "source_id").alias("item"),
        F.round("score", 3).alias("score"),
        list_or_empty("topics").alias("topics"),
        "sentiment",
        "stance",
        "text",
    )


def join_winners(items: DataFrame, hits: DataFrame, key: Sequence[str] = ("source", "source_id")) -> DataFrame:
    """The whole rows of ranked hits: rank on key and vector only, then fetch what few rows need."""
    # At most ``limit`` rows.
    return items.join(F.broadcast(hits.select(*key, "score")), list(key)).orderBy(F.col("score").desc(), *key)


def _best_rows(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``k`` highest scores per column; rows come in tie-break order."""
    if len(scores) <= k:
        rows, cols = np.indices(scores.shape)
        return rows.ravel(), cols.ravel()
    kth = -np.partition(-scores, k - 1, axis=0)[k - 1]
    above = scores > kth
    tied = scores == kth
    room = k - above.sum(axis=0)
    return np.nonzero(above | (tied & (np.cumsum(tied, axis=0) <= room)))


def _query_blocks(folder: str) -> Iterator[pa.Table]:
    """The written queries, a row group at a time."""
    system, root = fs.FileSystem.from_uri(folder)
    for info in sorted(system.get_file_info(fs.FileSelector(root)), key=lambda i: i.path):
        if info.path.endswith(".parquet"):
            with system.open_input_file(info.path) as source:
                for batch in pq.ParquetFile(source).iter_batches(batch_size=QUERIES_AT_ONCE):
                    yield pa.Table.from_batches([batch])


def _best_of(items: pa.Table, block: pa.Table, keys: list[str], k: int) -> pa.Table:
    """The ``k`` best of some items for each query of a block."""
    scores = np.full((items.num_rows, block.num_rows), -np.inf)
    queries = list(rows_by_length(block["embedding"].combine_chunks()))
    for rows, matrix in rows_by_length(items["embedding"].combine_chunks()):
        for columns, vectors in queries:
            scores[np.ix_(rows, columns)] = cosine_matrix(matrix, vectors)
    scores = scores.round(SCORE_DIGITS)
    rows, cols = _best_rows(scores, k)
    found = items.select(keys).take(pa.array(rows))
    return found.append_column("query_id", block["query_id"].take(pa.array(cols))).append_column("score", pa.array(scores[rows, cols]))


class BestPerQuery:
    """The ``k`` best items of each query over all that a task has seen.

    Handed out once, at the end: at most queries x k rows. A task with more of them than ``most_rows`` hands out what it
    holds and starts anew, which bounds its memory and changes no result.
    """

    def __init__(self, keys: Sequence[str], k: int, most_rows: int | None = None) -> None:
        self.keys, self.k, self.most_rows = list(keys), k, most_rows or BEST_ROWS
        self.held: dict[int, pa.Table] = {}

    def add(self, number: int, items: pa.Table, block: pa.Table) -> Iterator[pa.RecordBatch]:
        """Score items (in the order of their keys) against the queries of block ``number``."""
        if not items.num_rows or not block.num_rows:
            return
        new = _best_of(items, block, self.keys, self.k)
        self.held[number] = self._cut(pa.concat_tables([self.held[number], new])) if number in self.held else new
        if sum(t.num_rows for t in self.held.values()) > self.most_rows:
            yield from self.flush()

    def _cut(self, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("query_id", "ascending"), ("score", "descending"), *((c, "ascending") for c in self.keys)])
        codes = rows["query_id"].combine_chunks().dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
        place = np.arange(len(codes)) - np.repeat(starts, np.diff(np.r_[starts, len(codes)]))
        return rows.filter(pa.array(place < self.k))

    def flush(self) -> Iterator[pa.RecordBatch]:
        for table in self.held.values():
            yield from table.select([*self.keys, "query_id", "score"]).to_batches()
        self.held = {}


def semantic_search_multi(
    items: DataFrame,
    queries: DataFrame,
    k: int = 20,
    filters: SearchFilters | None = None,
    as_of: datetime | None = None,
    key: Sequence[str] = ("source_id",),
) -> DataFrame:
    """Top ``k`` items for each row of ``queries`` (query_id, embedding).

    The queries are written to the shared folder, from which each task reads them block by block, so no query
    passes the driver and the plan is the same for any number of them. One pass over the items:
    a task scores its items against a block as a matrix product and keeps the ``k`` best per query,
    so it hands out queries x k rows at most. Queries without a vector have no hits; ``query_id`` is unique.
    """
    spark, keys = items.sparkSession, list(key)
    candidates = searchable(items, filters, as_of).select(*keys, "embedding")
    folder = f"{shared_dir(spark)}/queries-{uuid.uuid4().hex}"
    queries.filter(has_vector("embedding")).select("query_id", F.col("embedding").cast("array<double>")).write.parquet(folder)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        kept = BestPerQuery(keys, k)

        def scored() -> Iterator[pa.RecordBatch]:
            # In the order of the keys, which settles ties.
            table = pa.Table.from_batches(held).sort_by([(c, "ascending") for c in keys])
            for number, block in enumerate(_query_blocks(folder)):
                yield from kept.add(number, table, block)

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= ITEMS_AT_ONCE:
                yield from scored()
                held = []
        if held:
            yield from scored()
        yield from kept.flush()

    schema = T.StructType(
        [items.schema[c] for c in keys] + [T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("score", T.DoubleType())]
    )
    found = candidates.mapInArrow(best, schema)
    return top_k_per_group(found, ["query_id"], [F.col("score").desc(), *map(F.col, key)], k)
