"""Token sequences of a fixed length, packed by vector best fit.

Every piece asks for three capacities of a sequence: tokens, one document and the attention cost length².
All three depend on the length alone, so pieces of equal length are interchangeable: the number of pieces per
length (at most ``max_tokens`` rows, whatever the corpus) decides the packing. The plan places whole classes,
longest first, each into the open sequences of the best score that hold it under every constraint; Spark
numbers the pieces within their lengths and looks their places up.

Defined results: a null text is empty and becomes the end id alone; repeated rows are packed as often as they
occur, also with equal or null ids; other columns are ignored; an empty table gives no piece.
"""

from __future__ import annotations

import base64
import functools
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedloom.llm.common import small_batches, written

# Pieces of one length are numbered inside runs of about so many.
RUN_ROWS = 16_384
# Letters and signs for which two libraries split a text in the same way; other texts take the slower one.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-\xac\xae-ɏ]*\Z")


@dataclass(frozen=True)
class Capacity:
    """Limits of a sequence, and the weight of each in the score."""

    tokens: int = 1024
    documents: int = 1024
    attention: int = 1024 * 1024
    weights: tuple[float, float, float] = (1.0, 0.001, 0.001)


@functools.lru_cache(maxsize=4)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.lru_cache(maxsize=4)
def _fast_tokenizer(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@dataclass(frozen=True)
class Vocabulary:
    """A file for ``tokenizers``, and optionally the same vocabulary as ranks, which is read for plain texts.

    Both give the same ids there; texts with other signs or with a special token's string always take the former.
    """

    path: str
    ranks: str | None = None
    pattern: str | None = None
    special: str = "<|endoftext|>"

    def ids(self, text: str) -> list[int]:
        if self.ranks and _PLAIN.match(text) and self.special not in text:
            return _fast_tokenizer(self.ranks, self.pattern).encode_ordinary(text)
        return _tokenizer(self.path).encode(text, add_special_tokens=False).ids


def token_pieces(docs: DataFrame, vocabulary: Vocabulary, max_tokens: int, end_id: int, with_ids: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document (doc_id, text).

    ``ids`` are little-endian unsigned 32-bit numbers. Only a document of more than ``max_tokens`` is cut; all
    its pieces but the first are full.
    """
    kinds = {"piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64()}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_id, texts = batch.column(0), batch.column(1)
            rows, columns, blobs = [], [[], [], [], []], []
            for row, text in enumerate(texts):
                ids = np.array([*vocabulary.ids(text.as_py() or ""), end_id], "<u4")
                first = len(ids) % max_tokens or max_tokens
                edges = [0, *range(first, len(ids) + 1, max_tokens)]
                for piece, (a, b) in enumerate(zip(edges, edges[1:])):
                    part = ids[a:b].tobytes()
                    rows.append(row)
                    for column, value in zip(columns, (piece, a, b - a, zlib.crc32(part))):
                        column.append(value)
                    if with_ids:
                        blobs.append(part)
            out = {"doc_id": doc_id.take(pa.array(rows, pa.int64()))} | {k: pa.array(c, t) for (k, t), c in zip(kinds.items(), columns)}
            if with_ids:
                out["ids"] = pa.array(blobs, pa.binary())
            yield pa.RecordBatch.from_pydict(out)

    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")
    return docs.select("doc_id", "text").mapInArrow(cut, schema)


def packing_plan(counts: dict[int, int], capacity: Capacity, score: str = "norm") -> list[tuple[int, int, int, int, int, int]]:
    """Where the pieces of each length go: (length, first, end, sequence, offset, per_sequence).

    The pieces numbered first..end-1 of a length fill sequences from ``sequence`` on, ``per_sequence`` in each,
    from ``offset`` on. ``score`` "norm" takes the open sequences whose residual vector, with the piece in it,
    has the least weighted norm; "dot" those whose residual has the largest weighted product with the piece.
    """
    cap = np.array([capacity.tokens, capacity.documents, capacity.attention], float)
    weights = np.array(capacity.weights)
    residual = np.zeros((0, 3))
    start, count, used = (np.zeros(0, np.int64) for _ in range(3))
    steps, opened = [], 0

    def add(rest, first, n, offset):
        nonlocal residual, start, count, used
        residual = np.vstack([residual, rest])
        start, count, used = np.append(start, first), np.append(count, n), np.append(used, offset)

    for length in sorted((x for x, n in counts.items() if n), reverse=True):
        item = np.array([length, 1, length * length], float)
        if (item > cap).any():
            raise ValueError(f"no sequence holds a piece of {length} tokens")
        left, rank = counts[length], 0
        while left:
            fits = np.flatnonzero((residual >= item).all(axis=1))
            if len(fits):
                if score == "dot":
                    value = -((residual[fits] / cap) * (item / cap) * weights).sum(axis=1)
                else:
                    value = (((residual[fits] - item) / cap) ** 2 * weights).sum(axis=1)
                at = fits[int(np.argmin(value))]
                rest, first, n, offset = residual[at].copy(), int(start[at]), int(count[at]), int(used[at])
            else:
                rest, first, n, offset, at = cap.copy(), opened, left, 0, None
            each = 1 if score == "dot" and at is not None else int(min(rest // item))
            each = min(each, left)
            taken = min(n, left // each)
            placed = taken * each
            steps.append((length, rank, rank + placed, first, offset, each))
            add(rest - each * item, first, taken, offset + each * length)
            rank, left = rank + placed, left - placed
            if at is None:
                opened += taken
            elif taken < n:
                start[at], count[at] = first + taken, n - taken
            else:
                keep = np.arange(len(count)) != at
                residual, start, count, used = residual[keep], start[keep], count[keep], used[keep]
    return steps


def pack(pieces: DataFrame, capacity: Capacity, score: str = "norm") -> DataFrame:
    """The pieces with sequence_id and offset; ``pieces`` is read several times, so give a written table."""
    spark = pieces.sparkSession
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most max_tokens rows
    runs = max(1, -(-sum(counts.values()) // RUN_ROWS))
    rows = pieces.withColumn("_run", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(runs)))
    before = Window.partitionBy("length").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy("length", "_run").count()
        .select("length", "_run", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    )
    inside = Window.partitionBy("length", "_run").orderBy("doc_id", "piece")
    numbered = rows.withColumn("_row", F.row_number().over(inside) - 1).join(offsets, ["length", "_run"])
    plan = spark.createDataFrame(
        packing_plan(counts, capacity, score),
        "length long, _first long, _end long, _sequence long, _offset long, _each long",
    )
    rank = F.col("_before") + F.col("_row")
    # The plan is bounded by max_tokens and not by the corpus, so it may be broadcast.
    placed = numbered.withColumn("_rank", rank).join(
        F.broadcast(plan).withColumnRenamed("length", "_length"),
        (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_end")),
    )
    at = F.col("_rank") - F.col("_first")
    return placed.select(
        *pieces.columns,
        (F.col("_sequence") + F.floor(at / F.col("_each"))).cast("long").alias("sequence_id"),
        (F.col("_offset") + at % F.col("_each") * F.col("length")).cast("long").alias("offset"),
    )


def pack_documents(
    docs: DataFrame,
    vocabulary: Vocabulary,
    capacity: Capacity = Capacity(),
    end_id: int = 2,
    with_ids: bool = True,
    score: str = "norm",
) -> DataFrame:
    """Tokenize, cut and pack documents (doc_id, text): one row per piece with its place."""
    return pack(written(token_pieces(docs, vocabulary, capacity.tokens, end_id, with_ids), "pieces"), capacity, score)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids) of packed pieces with ids; a sequence holds at most ``capacity.documents`` pieces."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select("sequence_id", joined.alias("ids"))
