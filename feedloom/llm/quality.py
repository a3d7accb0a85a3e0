"""A linear quality classifier: naive Bayes ratios as scales of n-gram indicators, hinge loss by dual coordinate descent.

A document's indicators are hashed n-grams of its words and of the words' shapes (runs of capitals, small letters
and digits shortened to one sign, other signs kept). Each is scaled by its log-count ratio between the two
classes, and a support vector machine is fitted on these: the method of naive Bayes support vectors. The margin becomes a score by a
logistic fit on labelled rows that the machine has not seen.

The machine is fitted on about ``sample_rows`` labelled documents at most, drawn by a hash of the id, one text of each,
and on ``sample_indicators`` indicators of theirs at most; both bound what reaches the driver. Counts for the ratios
come from the same rows. Every document is scored whole.

Defined results: null, empty and blank texts have no indicator and get the score of the intercept; rows of a null or
other label than 0 and 1 teach nothing; of conflicting labels of an id the larger counts, of several texts of an id the one of the least
hash; repeated rows are scored alike; ids may be of any type; other columns are ignored; without labelled
rows of both classes every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import held_out, small_batches, written
from feedloom.llm.words import WORDS_SLICE_BYTES, lower, mix, slices, span_hashes, spans

BUCKETS = 1 << 18
SAMPLE_ROWS = 20_000
SAMPLE_INDICATORS = 20_000_000
_SALTS = [np.uint64(x) for x in (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179, 0x9B05688C2B3E6C1F, 0x510E527FADE682D1, 0x3C6EF372FE94F82B, 0xA54FF53A5F1D36F1, 0xBB67AE8584CAA73B)]


def _shape_table() -> np.ndarray:
    """Bytes to signs: capitals A, small letters a, digits 0, bytes of other letters a; the rest stays."""
    out = np.arange(256, dtype=np.uint8)
    out[65:91], out[97:123], out[48:58], out[128:] = ord("A"), ord("a"), ord("0"), ord("a")
    return out


_SHAPE = _shape_table()


def _shapes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each word's shape, with runs of one sign shortened to one or two."""
    if not len(data):
        return np.zeros(0, np.uint64)
    sign = _SHAPE[data]
    # Two-byte letters: 0xC3 and below 0x9F is a capital of Latin-1; a lead byte alone adds nothing.
    lead = data >= 0xC0
    after = np.zeros(len(data), bool)
    after[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] < 0x9F)
    sign[after] = ord("A")
    same = np.zeros(len(data), bool)
    same[1:] = sign[1:] == sign[:-1]
    two = same.copy()
    two[1:] &= same[:-1]
    letter = (sign == ord("a")) | (sign == ord("A")) | (sign == ord("0"))
    drop = lead | (letter & same) | two
    starts = np.zeros(len(data), bool)
    starts[start] = True
    drop &= ~starts
    kept = np.cumsum(~drop)
    return span_hashes(sign[~drop], kept[start] - 1, kept[end - 1])


def indicators(texts: pa.Array, buckets: int = BUCKETS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, bucket, row): the distinct indicators of each text."""
    size = np.uint64(buckets)
    for first, end, data, offsets in slices(texts, WORDS_SLICE_BYTES):
        start, stop, row = spans(data, offsets)
        word = span_hashes(lower(data), start, stop)
        shape = _shapes(data, start, stop)
        parts, owners = [word + _SALTS[0], shape + _SALTS[1]], [row, row]
        for width, grams, salt in ((2, word, _SALTS[2]), (2, shape, _SALTS[3]), (3, shape, _SALTS[4])):
            if len(row) >= width:
                n = len(row) - width + 1
                value = grams[:n] + salt
                for k in range(1, width):
                    value = mix(value) + grams[k : n + k]
                inside = row[:n] == row[width - 1 :]
                parts.append(value[inside])
                owners.append(row[:n][inside])
        # A word that stands next to itself, twice or four times, is an n-gram of equal words whatever the word.
        for width, salt in ((2, _SALTS[5]), (4, _SALTS[6])):
            n = max(0, len(row) - width + 1)
            equal = row[:n] == row[width - 1 :] if n else np.zeros(0, bool)
            for k in range(1, width):
                equal = equal & (word[:n] == word[k : n + k])
            parts.append(np.full(int(equal.sum()), salt))
            owners.append(row[:n][equal])
        rows = end - first
        bucket = (mix(np.concatenate(parts)) % size).astype(np.int64)
        code = np.unique(np.concatenate(owners) * buckets + bucket)
        yield first, rows, code % buckets, code // buckets


@dataclass
class Model:
    weights: np.ndarray
    intercept: float
    slope: float
    offset: float


def _ratios(rows: list[np.ndarray], labels: np.ndarray, buckets: int, smoothing: float) -> np.ndarray:
    """The log-count ratio of each indicator, from the documents of the two classes that have it."""
    counts = np.full((2, buckets), smoothing)
    for row, label in zip(rows, labels):
        counts[label, row] += 1  # a row has each indicator once
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())


def dual_coordinate_descent(
    rows: list[np.ndarray], scales: np.ndarray, labels: np.ndarray, cost: float, passes: int, seed: int = 0
) -> tuple[np.ndarray, float]:
    """Weights and intercept of a linear machine with hinge loss, one dual variable at a time.

    Rows have the values ``scales`` at their indicators, divided by their norm, and a constant 1. A class counts
    by the inverse of its share. Variables at a bound with an outward gradient are passed over (shrinking).
    """
    y = np.where(labels > 0, 1.0, -1.0)
    share = np.array([(labels == 0).mean(), (labels == 1).mean()])
    upper = cost * 0.5 / share[labels.astype(int)]
    shrink = np.array([1 / max(np.sqrt(scales[r] @ scales[r]), 1e-12) for r in rows])
    weights, bias, alpha = np.zeros(len(scales)), 0.0, np.zeros(len(rows))
    order = np.random.default_rng(seed)
    active = np.arange(len(rows))
    for _ in range(passes):
        order.shuffle(active)
        worst, kept = 0.0, []
        for i in active:
            r = rows[i]
            v = scales[r] * shrink[i]
            gradient = y[i] * (weights[r] @ v + bias) - 1
            if (alpha[i] == 0 and gradient > 1) or (alpha[i] == upper[i] and gradient < -1):
                continue
            kept.append(i)
            projected = min(gradient, 0) if alpha[i] == 0 else max(gradient, 0) if alpha[i] == upper[i] else gradient
            worst = max(worst, abs(projected))
            if abs(projected) > 1e-9:
                new = min(max(alpha[i] - gradient / 2, 0), upper[i])  # norm 1 and the constant: 2
                change = (new - alpha[i]) * y[i]
                alpha[i] = new
                weights[r] += change * v
                bias += change
        if worst < 0.05:
            if len(active) == len(rows):
                break
            active = np.arange(len(rows))
        else:
            active = np.array(kept, dtype=np.int64)
    return weights, bias


def _logistic(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the labels' log odds, with the smoothed targets of Platt."""
    yes, no = (label == 1).sum(), (label == 0).sum()
    target = np.where(label == 1, (yes + 1) / (yes + 2), 1 / (no + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-9)
        g = np.array([((p - target) * margin).sum(), (p - target).sum()])
        h = np.array([[(w * margin * margin).sum() + 1e-6, (w * margin).sum()], [(w * margin).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        step *= min(1, 5 / max(np.abs(step).max(), 1e-12))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-7:
            break
    return float(a), float(b)


def training_labels(labels: DataFrame, label: str, sample_rows: int) -> DataFrame | None:
    """(doc_id, label): about ``sample_rows`` labels that may be learned from; None without both classes.

    A class may have half of them, and more where the other has fewer. The draw is by a hash of the id.
    """
    known = (
        labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("label"))
    )
    counts = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    if not counts.get(0) or not counts.get(1):
        return None
    room = {k: max(sample_rows // 2, sample_rows - counts[1 - k]) for k in (0, 1)}
    dice = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000))
    share = F.when(F.col("label") == 1, room[1] / counts[1]).otherwise(room[0] / counts[0])
    return known.where(dice < share * 1_000_000)


def training_rows(docs: DataFrame, labels: DataFrame, label: str, sample_rows: int) -> DataFrame | None:
    """(doc_id, text, label, dice): the sampled ids, each with one text, in the shared folder; None without both classes.

    An id that fills a third of the table is one row of each task before it is shuffled, and one row here.
    """
    chosen = training_labels(labels, label, sample_rows)
    if chosen is None:
        return None
    # The sampled labels are bounded, so they may be broadcast.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    one = rows.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"), F.first("label").alias("label"))
    return written(one.select("doc_id", "t.text", "label", F.xxhash64("doc_id", F.lit("order")).alias("dice")), f"{label}-sample")


def fit(
    docs: DataFrame, labels: DataFrame, label: str, sample_rows: int = SAMPLE_ROWS, buckets: int = BUCKETS, cost: float = 1.0, passes: int = 20, smoothing: float = 1.0,
    sample_indicators: int = SAMPLE_INDICATORS,
) -> Model:
    """A model of docs (doc_id, text) from labels (doc_id, label). The indicators of the sampled rows reach the driver."""
    nothing = Model(np.zeros(buckets), 0.0, 0.0, 0.0)
    small_batches(docs.sparkSession)
    sample = training_rows(docs, labels, label, sample_rows)
    if sample is None:
        return nothing

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, rows, bucket, owner in indicators(batch.column(0), buckets):
                edges = np.searchsorted(owner, np.arange(rows + 1))
                yield pa.RecordBatch.from_pydict(
                    {
                        "label": batch.column(1).slice(first, rows),
                        "dice": batch.column(2).slice(first, rows),
                        "n": np.diff(edges),
                        "found": pa.array([bucket[a:b].astype("<i4").tobytes() for a, b in zip(edges, edges[1:])], pa.binary()),
                    }
                )

    gathered = written(sample.select("text", "label", "dice").mapInArrow(gather, "label int, dice long, n long, found binary"), "indicators")
    sizes = gathered.select("dice", "n").orderBy("dice").toArrow()  # one row for each sampled id
    inside = np.cumsum(sizes["n"].to_numpy()) <= sample_indicators
    if not inside.any():
        return nothing
    last = int(sizes["dice"].to_numpy()[np.flatnonzero(inside)[-1]])
    got = gathered.where(F.col("dice") <= last).select("label", "dice", "found").toArrow()
    order = np.argsort(got["dice"].to_numpy(), kind="stable")
    classes = got["label"].to_numpy()[order]
    found = got["found"].combine_chunks()
    rows = [np.frombuffer(found[i].as_buffer(), "<i4") for i in order.tolist()]  # views of what was gathered
    if len(set(classes)) < 2:
        return nothing
    model = fit_rows(rows, classes, buckets, cost, passes, smoothing)
    # What was gathered is given back to the system and not kept for later.
    del rows, found, got
    pa.default_memory_pool().release_unused()
    return model


def fit_rows(rows: list[np.ndarray], labels: np.ndarray, buckets: int, cost: float, passes: int, smoothing: float) -> Model:
    def machine(chosen: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
        own = [rows[i] for i in chosen]
        scales = _ratios(own, labels[chosen], buckets, smoothing)
        weights, bias = dual_coordinate_descent(own, scales, labels[chosen], cost, passes)
        return weights * scales, bias, scales

    def margins(chosen, weights, bias, scales):
        return np.array([weights[rows[i]].sum() / max(np.sqrt((scales[rows[i]] ** 2).sum()), 1e-12) + bias for i in chosen])

    dice = np.random.default_rng(1).permutation(len(rows))
    held, rest = dice[::5], np.setdiff1d(dice, dice[::5])
    if len(set(labels[rest])) < 2:
        rest = dice
    slope, offset = _logistic(margins(held, *machine(rest)), labels[held])
    weights, bias, scales = machine(np.arange(len(rows)))
    return Model(np.column_stack([weights, scales * scales]).astype(np.float64), bias, slope, offset)


def text_scores(texts: pa.Array, model: Model) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, rows, scores) for slices of the texts."""
    weights = model.weights if model.weights.ndim == 2 else np.column_stack([model.weights, model.weights])
    for first, rows, bucket, owner in indicators(texts, len(weights)):
        total = np.bincount(owner, weights[bucket, 0], rows)
        norm = np.sqrt(np.bincount(owner, weights[bucket, 1], rows))
        margin = total / np.maximum(norm, 1e-12) + model.intercept
        yield first, rows, 1 / (1 + np.exp(-np.clip(model.slope * margin + model.offset, -30, 30)))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row of docs (doc_id, text). The model has a fixed size and is broadcast."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.weights, model.intercept, model.slope, model.offset))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches:
            for first, rows, value in text_scores(batch.column(1), own):
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).slice(first, rows), "score": value})

    small_batches(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(score, f"doc_id {kind}, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    model = fit(docs, labels, "quality", sample_rows)
    return scored(docs, model).select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def accepted(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, threshold: float = 0.3) -> DataFrame:
    """The rows of docs (with all their columns) whose text scores at least ``threshold``."""
    model = fit(docs, labels, "quality", sample_rows)
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.intercept, model.slope, model.offset))
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches:
            for first, rows, score in text_scores(batch.column(at), own):
                yield batch.slice(first, rows).filter(pa.array(score >= threshold))

    small_batches(docs.sparkSession)
    return docs.mapInArrow(keep, docs.schema)
