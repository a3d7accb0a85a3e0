"""An offline embedder with meaning: TF-IDF rows projected on the leading right singular vectors of a corpus.

Words that occur together in texts lie in the same directions, so texts of one subject are near each other without a word in
common. The vectors are found by a randomized SVD: a random block of directions is driven through the matrix and
its transpose a few times (each pass is one job over the rows, whose partial products are added per block of terms), and
the product of the rows with the directions found is factored by a TSQR, a QR of each task's rows and then of the stacked
triangles.

The fit takes every text: words are counted over all of them, and all rows go through each pass. The model is bounded by
parameters: ``terms`` words (those in the most texts) and ``size`` directions. What reaches the driver is ``terms`` x ``size``
numbers. Texts are read twice and not copied; rows are staged as places and counts. Any number of texts is embedded with the
model, which each Python worker loads once from its folder.

Defined results: null and empty texts and texts without a known word have a zero vector; signs are fixed by the largest part.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from feedloom.session import staged

TERMS = 20_000
SIZE = 64
# More directions than are kept, and how often they go through the matrix and back.
EXTRA, PASSES = 16, 4
# Terms whose partial products are one row, added by one group.
TERMS_AT_ONCE = 1_024
SLOTS = 32
# A task hands on the counts of so many words at once.
WORDS_AT_ONCE = 1 << 18
# In a pass a task adds up a number for each term and direction; it gets so many entries for each of them at least.
ENTRIES_PER_SUM = 4
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


class LatentEmbedder:
    """A provider: ``partial(LatentEmbedder, folder)`` of a fitted model's folder."""

    batch_size = 1 << 14

    def __init__(self, folder: str) -> None:
        system, root = fs.FileSystem.from_uri(folder)
        parts = []
        for info in sorted(system.get_file_info(fs.FileSelector(root)), key=lambda i: i.path):
            if info.path.endswith(".parquet"):
                with system.open_input_file(info.path) as source:
                    parts.append(pq.read_table(source))
        rows = pa.concat_tables(parts).sort_by("place")
        self.place = {t: i for i, t in enumerate(rows["term"].to_pylist())}
        self.idf = rows["idf"].to_numpy()
        axes = [np.frombuffer(a, np.float64) for a in rows["axes"].to_pylist()]
        self.axes = np.vstack(axes) if axes else np.zeros((0, 0))

    def embed(self, texts: list[str]) -> list[Sequence[float]]:
        out = np.zeros((len(texts), self.axes.shape[1]))
        for i, text in enumerate(texts):
            at, value = tf_idf(text, self.place, self.idf)
            if len(at):
                out[i] = value @ self.axes[at]
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        # What is left of a row by rounding alone has no direction.
        return list(np.divide(out, norms, out=np.zeros_like(out), where=norms > 1e-9).astype(np.float32))


def known_words(text: str | None, place: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(places, counts) of the known words of a text, by place."""
    seen = Counter(map(place.get, words_of(text)))
    seen.pop(None, None)
    at, n = np.fromiter(seen, np.int32, len(seen)), np.fromiter(seen.values(), np.int32, len(seen))
    order = np.argsort(at)
    return at[order], n[order]


def tf_idf(text: str | None, place: dict[str, int], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, weights) of the known words of a text, of length 1: (1 + ln n) idf."""
    at, n = known_words(text, place)
    weight = (1 + np.log(n)) * idf[at]
    return at, weight / np.linalg.norm(weight) if len(at) else weight


def text_counts(batches: Iterator[pa.RecordBatch], at_once: int = WORDS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """(term, n): in how many texts a word is; all texts are counted under NULL. A term can come more than once."""
    seen: Counter[str | None] = Counter()

    def handed_on() -> pa.RecordBatch:
        out = pa.RecordBatch.from_pydict({"term": pa.array(seen.keys(), pa.string()), "n": pa.array(seen.values(), pa.int64())})
        seen.clear()
        return out

    for batch in batches:
        for text in batch.column(0):
            seen.update(set(words_of(text.as_py())))
            seen[None] += 1
            if len(seen) > at_once:
                yield handed_on()
    if seen:
        yield handed_on()


Rows = Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, np.ndarray]]]


def _decoded(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, weights) of each row, one at a time; a row has a place once."""
    for at, weight in zip(*batch.columns):
        yield np.frombuffer(at.as_buffer(), np.int32), np.frombuffer(weight.as_buffer(), np.float64)


def _weighed(batch: pa.RecordBatch, idf: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, weights) of each row of places and counts, as ``tf_idf`` has them."""
    ends = np.cumsum(batch.column(0).value_lengths())
    places, counts = (c.flatten().to_numpy() for c in batch.columns)
    weights = (1 + np.log(counts)) * idf[places]
    for first, end in zip([0, *ends[:-1]], ends):
        weight = weights[first:end]
        yield places[first:end], weight / np.linalg.norm(weight)


def _times(batch: pa.RecordBatch, directions: np.ndarray, decoded: Rows = _decoded) -> np.ndarray:
    """The rows' products with the directions; only one row's part of the directions is copied at once."""
    out = np.zeros((batch.num_rows, directions.shape[1]))
    for i, (at, weight) in enumerate(decoded(batch)):
        out[i] = weight @ directions.take(at, 0)
    return out


def _back_and_forth(rows: DataFrame, directions: np.ndarray, decoded: Rows = _decoded) -> np.ndarray:
    """A' A times the directions."""
    terms, width = directions.shape
    shared = rows.sparkSession.sparkContext.broadcast(directions)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((terms, width))
        for batch in batches:
            for at, weight in decoded(batch):
                part = shared.value.take(at, 0)
                np.multiply.outer(weight, weight @ part, out=part)
                part += total.take(at, 0)
                total[at] = part
        for first in range(0, terms, TERMS_AT_ONCE):
            part = total[first : first + TERMS_AT_ONCE]
            yield pa.RecordBatch.from_pydict({"first": pa.array([first], pa.int32()), "data": pa.array([part.tobytes()], pa.binary())})

    def add(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The parts of more tasks than a batch holds are never together.
        first, total = None, 0.0
        for batch in group:
            for f, d in zip(batch.column("first"), batch.column("data")):
                first, total = f, total + np.frombuffer(d.as_buffer(), np.float64)
        yield pa.RecordBatch.from_pydict({"first": pa.array([first.as_py()], pa.int32()), "data": pa.array([total.tobytes()], pa.binary())})

    sums = rows.mapInArrow(local, "first int, data binary").groupBy("first").applyInArrow(add, "first int, data binary").collect()
    parts = [np.frombuffer(r.data, np.float64).reshape(-1, width) for r in sorted(sums, key=lambda r: r.first)]
    shared.unpersist()
    return np.vstack(parts)


def tsqr(rows: DataFrame, directions: np.ndarray, decoded: Rows = _decoded) -> np.ndarray:
    """R of the QR factors of the rows' products with the directions: a triangle per task, stacked and factored again."""
    width = directions.shape[1]
    shared = rows.sparkSession.sparkContext.broadcast(directions)

    def triangle(stack: list[np.ndarray]) -> np.ndarray:
        return np.linalg.qr(np.vstack(stack), mode="r")

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, width))
        for batch in batches:
            if batch.num_rows:
                r = triangle([r, _times(batch, shared.value, decoded)])
        if len(r):
            yield pa.RecordBatch.from_pydict({"data": pa.array([r.tobytes()], pa.binary())})

    def fold(group: pa.Table) -> pa.Table:
        r = triangle([np.frombuffer(d.as_buffer(), np.float64).reshape(-1, width) for d in group.column("data")])
        return pa.table({"data": pa.array([r.tobytes()], pa.binary())})

    local_r = rows.mapInArrow(local, "data binary").withColumn("slot", F.spark_partition_id() % SLOTS)
    folded = local_r.groupBy("slot").applyInArrow(fold, "data binary").collect()  # one triangle for each slot
    return triangle([np.frombuffer(r.data, np.float64).reshape(-1, width) for r in folded])


def frequent_terms(texts: DataFrame, terms: int, least_texts: int) -> tuple[int, list[Row]]:
    """How many texts there are, and the (term, n) that are in the most of them, by number and term."""
    every = texts.mapInArrow(text_counts, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    counts = staged(every.filter((F.col("n") >= least_texts) | F.col("term").isNull()), "latent-counts")
    whole, often = counts.filter(F.col("term").isNull()).first(), counts.filter(F.col("term").isNotNull())
    # The least number that is kept, so that no task sends the driver terms that others leave behind.
    cut, left = least_texts, terms
    for r in often.groupBy("n").agg(F.count("*").alias("m")).orderBy(F.desc("n")).limit(terms).collect():
        cut, left = r.n, left - r.m
        if left <= 0:
            break
    return whole.n if whole else 0, often.filter(F.col("n") >= cut).orderBy(F.desc("n"), "term").limit(terms).collect()


def fit_latent(
    docs: DataFrame, folder: str, key: str = "doc_id", text: str = "text", size: int = SIZE, terms: int = TERMS, sample_rows: int | None = None, least_texts: int = 2, seed: int = 0
):
    """Fit the embedder on docs and write it to ``folder``; returns the provider.

    All texts are fitted, unless the caller asks for ``sample_rows`` of them (those of the least hashes).
    """
    spark = docs.sparkSession
    texts = docs.select(text)
    if sample_rows is not None:
        dice = F.xxhash64(F.col(key), F.col(text))
        # Drawn by hash alone, so the texts of the others do not move.
        cut = docs.select(dice.alias("d")).orderBy("d").limit(sample_rows).agg(F.max("d")).first()[0]
        texts = docs.filter(dice <= cut).select(text) if cut is not None else texts.limit(0)
    count, kept = frequent_terms(texts, terms, least_texts)
    place = {r.term: i for i, r in enumerate(kept)}
    idf = np.array([np.log((1 + count) / (1 + r.n)) + 1 for r in kept])
    shared = spark.sparkContext.broadcast((place, idf))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, _ = shared.value
        for batch in batches:
            rows = [(at, n) for at, n in (known_words(t.as_py(), known) for t in batch.column(0)) if len(at)]
            if rows:
                ends = np.cumsum([0, *(len(at) for at, _ in rows)], dtype=np.int32)
                columns = [pa.ListArray.from_arrays(ends, np.concatenate(c)) for c in zip(*rows)]
                yield pa.RecordBatch.from_arrays(columns, ["at", "n"])

    def decoded(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        return _weighed(batch, shared.value[1])

    width = min(len(place), size + EXTRA)
    axes = np.zeros((len(place), 0))
    if width:
        rows = staged(texts.mapInArrow(placed, "at array<int>, n array<int>"), "latent-rows")
        # A row has an entry for each of its words. However small the files are, the tasks of a pass hand on one task's sums, or as many as a quarter of the entries.
        rows = rows.coalesce(-(-sum(r.n for r in kept) // (ENTRIES_PER_SUM * len(place) * width)))
        directions, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(place), width)))
        for _ in range(PASSES):
            directions, _ = np.linalg.qr(_back_and_forth(rows, directions, decoded))
        _, strength, turn = np.linalg.svd(tsqr(rows, directions, decoded))
        alive = strength > strength[0] * 1e-9
        axes = (directions @ turn.T)[:, : len(strength)][:, alive][:, :size]
        axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])
    model = [(i, r.term, float(idf[i]), axes[i].tobytes()) for i, r in enumerate(kept)]
    spark.createDataFrame(model, "place int, term string, idf double, axes binary").coalesce(1).write.parquet(folder)
    return partial(LatentEmbedder, folder)
