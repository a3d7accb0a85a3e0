"""Toxicity by a weighted lexicon that is matched with an Aho-Corasick automaton on folded text.

Folding: Unicode compatibility forms, small letters, look-alike letters of other scripts and digits or signs that stand for letters
become the letters meant; other signs become spaces. Entries are words and stems (beginnings of words) whose
share among toxic documents is far above that among clean ones; an entry's weight is the log ratio of the two. Of
entries at one word the heaviest counts. A hit inside an exception phrase does not count: phrases may be given, and
pairs of words around hits that clean documents use are learned. The weights of a document's hits are summed, as they are and per
word, and a logistic fit of both on the labelled rows gives the score.

Labels are learned from about ``sample_rows`` documents at most, drawn by a hash of the id, one text of each, which bounds
the lexicon as well. Every document is scored whole, in time of its length and its hits.

Defined results: null, empty and blank texts have no hit and the score of a text without hits; without labels of both classes,
every score is 0.5 and predicted 1; of conflicting labels of an id the larger counts, of several texts of an id the one of the least
hash; rows of one id, repeated or not, are scored one by one; ids may be of any type; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import held_out, small_batches
from feedloom.llm.quality import training_rows

SAMPLE_ROWS = 20_000
STEMS = (4, 5, 6, 7, 8)

# Letters of other scripts that look like Latin ones, and digits and signs that stand for letters.
LOOK_ALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y",
    "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ɡ": "g", "һ": "h", "ո": "n", "ս": "u", "ν": "v", "α": "a",
    "ε": "e", "ι": "i", "κ": "k", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "η": "n", "ı": "i", "ɑ": "a",
}
STANDING = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}

_TABLE = str.maketrans(
    {chr(c): " " for c in range(0xC0) if not chr(c).isalnum()}
    | {"’": " ", "‘": " ", "“": " ", "”": " ", "–": " ", "—": " ", "…": " "}
    | LOOK_ALIKES
    | STANDING
)
_COMPATIBLE = re.compile(r"[^\x00-ɏͰ-׿‐-‧]")


def folded(text: str | None) -> str:
    """The folded words, each between single spaces; one space for a text without words."""
    text = text or ""
    if not text.isascii() and _COMPATIBLE.search(text):
        text = unicodedata.normalize("NFKC", text)
    words = text.lower().translate(_TABLE).split()
    return f" {' '.join(words)} " if words else " "


@dataclass
class Lexicon:
    """Entries begin with a space and, when they are whole words, end with one; phrases have both."""

    entries: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    calibration: tuple[float, float, float] = (0.0, 0.0, 0.0)

    def automaton(self) -> ahocorasick.Automaton:
        machine = ahocorasick.Automaton()
        for entry, weight in self.entries.items():
            machine.add_word(entry, (len(entry), weight))
        for phrase in self.exceptions:
            machine.add_word(phrase, (len(phrase), None))
        machine.make_automaton()
        return machine


def hits(machine: ahocorasick.Automaton, text: str) -> dict[int, float]:
    """The weight at the start of each word hit of a folded text, exceptions taken out."""
    if not len(machine):
        return {}
    found: dict[int, float] = {}
    excused: list[tuple[int, int]] = []
    for last, (size, weight) in machine.iter(text):
        start = last - size + 1
        if weight is None:
            excused.append((start, last))
        elif weight > found.get(start, 0.0):
            found[start] = weight
    if not excused or not found:
        return found
    # One sweep over the phrases and the hits in the order of their starts.
    kept, reach, phrases = {}, -1, iter(sorted(excused))
    phrase = next(phrases, None)
    for start in sorted(found):
        while phrase is not None and phrase[0] <= start:
            reach, phrase = max(reach, phrase[1]), next(phrases, None)
        if start >= reach:
            kept[start] = found[start]
    return kept


def _features(total: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.column_stack([np.log1p(total), np.log1p(1000 * total / np.maximum(words, 1)), np.ones(len(total))])


def _count_terms(rows: DataFrame, exceptions: list[str]) -> DataFrame:
    """(term, toxic, clean): in how many labelled documents (text, label) each word and stem occurs outside exceptions."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = (Counter(), Counter())
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = folded(text)
                for phrase in exceptions:
                    text = text.replace(phrase, " ")
                words = set(text.split())
                terms = {f" {w} " for w in words}
                for n in STEMS:
                    terms |= {f" {w[:n]}" for w in words if len(w) >= n}
                seen[label].update(terms)
            terms = list(seen[0] | seen[1])
            yield pa.RecordBatch.from_pydict(
                {"term": pa.array(terms, pa.string()), "toxic": pa.array([seen[1][t] for t in terms], pa.int64()), "clean": pa.array([seen[0][t] for t in terms], pa.int64())}
            )

    counted = rows.select("text", "label").mapInArrow(count, "term string, toxic long, clean long")
    return counted.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _count_phrases(rows: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(phrase, toxic, clean): in how many labelled documents each pair of words around a hit occurs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = lexicon.automaton()
        for batch in batches:
            seen = (Counter(), Counter())
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text, phrases = folded(text), set()
                for start in hits(machine, text):
                    end = text.index(" ", start + 1)
                    after = text.find(" ", end + 1)
                    before = text.rfind(" ", 0, start)
                    if after > 0:
                        phrases.add(text[start : after + 1])
                    if before >= 0:
                        phrases.add(text[before : end + 1])
                seen[label].update(phrases)
            found = list(seen[0] | seen[1])
            yield pa.RecordBatch.from_pydict(
                {"phrase": pa.array(found, pa.string()), "toxic": pa.array([seen[1][t] for t in found], pa.int64()), "clean": pa.array([seen[0][t] for t in found], pa.int64())}
            )

    counted = rows.select("text", "label").mapInArrow(count, "phrase string, toxic long, clean long")
    return counted.groupBy("phrase").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _weighed(docs: DataFrame, lexicon: Lexicon, *extra: str) -> DataFrame:
    """(doc_id, *extra, total, words): the summed weights of a text's hits and its number of words."""
    entries, exceptions = docs.sparkSession.sparkContext.broadcast(lexicon.entries), lexicon.exceptions

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Lexicon(entries.value, exceptions).automaton()
        for batch in batches:
            total, words = [], []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                text = folded(text)
                total.append(sum(hits(machine, text).values()))
                words.append(text.count(" ") - 1)
            kept = {batch.schema.names[i]: batch.column(i) for i in range(batch.num_columns - 1)}
            yield pa.RecordBatch.from_pydict(kept | {"total": pa.array(total, pa.float64()), "words": pa.array(words, pa.int64())})

    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in ("doc_id", *extra))
    return docs.select("doc_id", *extra, "text").mapInArrow(weigh, f"{kinds}, total double, words long")


def _pruned(weights: dict[str, float]) -> dict[str, float]:
    """Without entries that a stem of about their weight, or a heavier one, covers."""
    kept: dict[str, float] = {}
    for term in sorted(weights, key=lambda t: (len(t.rstrip()), t)):
        stem = max((kept.get(term[:n], 0.0) for n in range(3, len(term))), default=0.0)
        if weights[term] > 1.25 * stem:
            kept[term] = weights[term]
    return kept


def learn(
    docs: DataFrame,
    labels: DataFrame,
    sample_rows: int = SAMPLE_ROWS,
    exceptions: tuple[str, ...] = (),
    least_documents: int = 4,
    least_ratio: float = 8.0,
    least_deviation: float = 8.0,
) -> Lexicon | None:
    """A lexicon from docs (doc_id, text) and labels (doc_id, toxic); None without labels of both classes."""
    small_batches(docs.sparkSession)
    rows = training_rows(docs, labels, "toxic", sample_rows)
    if rows is None:
        return None
    number = {r[0]: r[1] for r in rows.groupBy("label").count().collect()}
    if len(number) < 2:
        return None
    weight = F.log((F.col("toxic") + 0.5) / (number[1] + 1.0)) - F.log((F.col("clean") + 0.5) / (number[0] + 1.0))
    # How many toxic documents would hold a term by chance, and by how many deviations more do.
    chance = (F.col("clean") + 1) * (number[1] / number[0])
    deviation = (F.col("toxic") - chance) / F.sqrt(chance + 1)
    terms = (
        _count_terms(rows, [folded(p) for p in exceptions])
        .where((F.col("toxic") >= least_documents) & (deviation >= least_deviation) & (weight >= float(np.log(least_ratio))))
        .select("term", weight.alias("weight"))
    )
    lexicon = Lexicon(_pruned({r[0]: r[1] for r in terms.collect()}), [folded(p) for p in exceptions])
    benign = (
        _count_phrases(rows, lexicon)
        .where((F.col("clean") >= least_documents) & (F.col("clean") * number[1] >= 2 * F.col("toxic") * number[0]))
    )
    lexicon.exceptions += sorted(r[0] for r in benign.select("phrase").collect())
    table = _weighed(rows, lexicon, "label").select("label", "total", "words").toArrow()  # bounded by sample_rows
    lexicon.calibration = _logistic(
        _features(table["total"].to_numpy(), table["words"].to_numpy()), table["label"].to_numpy()
    )
    return lexicon


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, ...]:
    """Ridge logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * w
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step * min(1, 3 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def toxicity_scores(
    docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, exceptions: tuple[str, ...] = (), threshold: float = 0.5
) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    lexicon = learn(docs, labels, sample_rows, exceptions) or Lexicon()
    small_batches(docs.sparkSession)
    a, b, c = lexicon.calibration
    logit = a * F.log1p("total") + b * F.log1p(1000 * F.col("total") / F.greatest("words", F.lit(1))) + c
    return _weighed(docs, lexicon).select("doc_id", (1 / (1 + F.exp(-logit))).alias("score")).select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
