"""Secrets in texts: three base patterns, and random strings that a tokenizer's vocabulary cannot shorten.

Base spans are assignments to a secret's name, access keys and long hexadecimal runs. The method looks at every other run
of ``MIN_RUN`` or more letters, digits and the signs of base64. A vocabulary made from language cuts words into long
tokens and random strings into short ones, so a run with fewer characters per token than ``max_ratio`` becomes a span of
kind ``token``. Before the test, what only looks random is put aside: digests of known lengths, UUIDs, numbers, single
words, and names whose parts (between signs, changes of case, letters and digits) are long on average. A run that overlaps a
base span is left to it.

Defined results: null texts are empty; empty texts have no span; rows of one id and repeated rows are scanned each by
itself; rows without id keep their row; a run of any length is measured whole, in pieces of ``PIECE`` characters; other
columns are ignored; an empty table gives no rows. Places are code points, the end exclusive.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import small_batches

# The base kinds in their order, and what each looks like. ASCII letters only are alike in either case.
ASSIGN = r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_CHARS, ACCESS_CHARS, HEX_CHARS = 6, 20, 24
KINDS = ("assign", "access", "hex", "token")
# Hexadecimal digits of common digests (MD5, SHA-1, SHA-2).
DIGEST_CHARS = (32, 40, 48, 56, 64, 96, 128)

MIN_RUN = 20
RUN = r"[A-Za-z0-9+/_-]"
PIECE = 256
# Parts of names are at least this long on average.
PART_CHARS = 3.5
SPANS = "array<struct<kind:string,start:long,end:long,base:boolean,ratio:double>>"

_assign = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
# Possessive and with fixed starts: the same matches, linear on long runs.
_access = re.compile(rf"AKIA[A-Z0-9]{{{ACCESS_CHARS - 4},}}+")
_hex = re.compile(rf"(?<![0-9a-f])[0-9a-f]{{{HEX_CHARS},}}+")
_run = re.compile(rf"(?<!{RUN}){RUN}{{{MIN_RUN},}}+={{0,2}}")
_digest = re.compile(r"[0-9a-f]+|[0-9A-F]+")
_uuid = re.compile(r"[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}")
_part = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


@dataclass(frozen=True)
class RankFile:
    """A tiktoken vocabulary: the file of ranks, the pattern that cuts texts."""

    path: str
    pattern: str

    def encoding(self):
        import tiktoken

        with open(self.path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        return tiktoken.Encoding("ranks", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})


def known(run: str) -> bool:
    """True for digests, UUIDs, numbers, words and names."""
    if len(run) in DIGEST_CHARS and _digest.fullmatch(run):
        return True
    if _uuid.fullmatch(run):
        return True
    parts = _part.findall(run)
    letters = sum(c.isalpha() for c in run)
    if not letters or len(parts) <= 1:
        return True
    # Short endings and numbers are common in names, so the average decides.
    return sum(map(len, parts)) >= PART_CHARS * len(parts)


def characters_per_token(run: str, encode) -> float:
    pieces = [run[i : i + PIECE] for i in range(0, len(run), PIECE)]
    return len(run) / max(1, sum(len(encode(p)) for p in pieces))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base kinds, by start and then kind."""
    found = [("assign", m.start(), m.end()) for m in _assign.finditer(text) if len(m.group(2)) >= ASSIGN_CHARS]
    found += [("access", m.start(), m.end()) for m in _access.finditer(text)]
    found += [("hex", m.start(), m.end()) for m in _hex.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def random_runs(text: str, base: list[tuple[str, int, int]], encode, max_ratio: float) -> list[tuple[int, int, float]]:
    """(start, end, ratio) of the runs that the vocabulary cannot shorten. ``base`` is in order of starts."""
    out, at, reach = [], 0, -1
    for m in _run.finditer(text):
        # Base spans that begin before the run's end; the farthest end of them tells whether one overlaps.
        while at < len(base) and base[at][1] < m.end():
            reach = max(reach, base[at][2])
            at += 1
        run = m.group()
        if reach > m.start() or known(run.rstrip("=")):
            continue
        ratio = characters_per_token(run, encode)
        if ratio < max_ratio:
            out.append((m.start(), m.end(), ratio))
    return out


def secret_spans(docs: DataFrame, vocabulary: RankFile, max_ratio: float = 1.9) -> DataFrame:
    """(doc_id, spans) for each row of docs (doc_id, text): kind, start, end, base, characters per token."""
    small_batches(docs.sparkSession)
    kind_of_id = docs.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = vocabulary.encoding().encode_ordinary
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("ratio", pa.float64())]))
        for batch in batches:
            texts = batch.column(1)
            # One pass of a linear matcher leaves few texts to look at closely.
            possible = pc.or_(
                pc.match_substring_regex(texts, rf"{ASSIGN.split('[')[0]}[\"']? *[:=]", ignore_case=True),
                pc.match_substring_regex(texts, rf"{RUN}{{{MIN_RUN}}}"),
            )
            rows = [[] for _ in range(batch.num_rows)]
            for i in pc.indices_nonzero(possible.fill_null(False)).to_pylist():
                text = texts[i].as_py()
                base = base_spans(text)
                spans = [{"kind": k, "start": a, "end": b, "base": True, "ratio": None} for k, a, b in base]
                spans += [{"kind": "token", "start": a, "end": b, "base": False, "ratio": r} for a, b, r in random_runs(text, base, encode, max_ratio)]
                rows[i] = sorted(spans, key=lambda s: (s["start"], KINDS.index(s["kind"])))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "spans": pa.array(rows, kind)})

    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {kind_of_id}, spans {SPANS}")


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secrets(docs: DataFrame, vocabulary: RankFile, max_ratio: float = 1.9) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_token) for each row of docs (doc_id, text)."""
    found = secret_spans(docs, vocabulary, max_ratio)

    def number(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *[number(k) for k in KINDS[:3]],
        F.sha2(_listed(F.filter("spans", lambda s: s["base"])), 256).alias("base_sha256"),
        _listed(F.col("spans")).alias("spans"),
        number("token"),
    )
