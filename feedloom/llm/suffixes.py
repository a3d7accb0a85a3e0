"""Repeated passages across documents: suffixes at content-defined places, range-partitioned, sorted, compared.

Of all suffixes, those are sorted that a window needs: each window of ``length`` bytes picks the 16-byte gram of
least hash within it, and neighbouring windows that pick the same place form a run. Equal windows pick equal places, so
two documents can share a window only where they have a suffix with the same leading 16 bytes.

1. A scan makes the runs of each document and sends (leading bytes, hash of the run's whole stretch, document,
   place) in compressed blocks to buckets, whose splitters are quantiles of sampled leading bytes; a heavy prefix
   that fills several splitters is spread by the bytes after it and, once each, by the nearest bytes to the right and
   to the left of the 16, so a gram of a third of all documents fills no bucket. Runs whose stretch occurs in an earlier document of the same scan
   buffer are settled there, so a passage of a third of all documents sends a row per buffer.
2. A bucket sorts its suffixes eight bytes at a time and only among equals (multikey quicksort). A run whose stretch an earlier
   document has is settled as a whole. Runs that share the leading bytes with an earlier document, but no whole
   stretch, are pending, and the first of each stretch are their sources.
3. Pending runs and sources fetch their bytes, meet by leading bytes and the nearest bytes of one side, and their windows
   that hold these bytes are compared in full. Every window holds the nearest bytes of one side at least.
4. All windows found are laid over the texts.

Two stretches are taken for equal by 16 bytes of text and a 48-bit hash; the windows of step 3 are compared byte for byte.

Defined results: null texts are empty; texts shorter than ``length`` keep all; rows of equal id are not earlier than one
another; rows without id keep all and remove nothing; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import small_batches, written
from feedloom.llm.words import mix, prefix_sums, slices, spans_of

GRAM = 16
# Text per bucket of suffixes, and suffixes that a scan holds before it sends them.
BUCKET_BYTES = 8_000_000
BUFFER_RUNS = 400_000
# About so many rows are sampled for the splitters, and of each one in so many suffixes, or as many as bound it.
SAMPLE_DOCS, SAMPLE_STEP, SAMPLE_MOST = 2_000, 16, 1_000
SETTLED, PENDING, SOURCE = 1, 2, 4
_MULT = np.uint64(0x9E3779B97F4A7C15)


def _words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as little-endian numbers."""
    return np.ndarray((max(0, len(data) - 7),), "<u8", data, strides=(1,))


def runs(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(row, place of the gram, first window, windows) of the runs of all texts in ``data``."""
    n, wide = len(data), length - GRAM + 1
    if n < length:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    eight = _words_at(data)
    gram = mix(eight[: n - GRAM + 1] * _MULT + mix(eight[8 : n - GRAM + 9].copy()))
    code = (gram & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(gram), dtype=np.uint64)
    width = 1
    while width * 2 <= wide:
        code = np.minimum(code[:-width], code[width:])
        width *= 2
    if width < wide:
        code = np.minimum(code[: len(code) - (wide - width)], code[wide - width :])
    place = (code & np.uint64(0xFFFFFFFF)).astype(np.int64)
    # Windows that lie inside one text.
    size = np.diff(offsets)
    inside = np.zeros(n + 1, np.int64)
    long = size >= length
    np.add.at(inside, offsets[:-1][long], 1)
    np.add.at(inside, offsets[1:][long] - length + 1, -1)
    inside = np.cumsum(inside[: len(place)]) > 0
    starts = inside.copy()
    same = np.zeros(len(place), bool)
    same[1:] = (place[1:] == place[:-1]) & inside[:-1]
    edge = offsets[1:-1]
    same[edge[edge < len(place)]] = False
    starts &= ~same
    first = np.flatnonzero(starts)
    # A run ends at the next run or at the last window before a gap.
    ends = inside.copy()
    ends[:-1] &= starts[1:] | ~inside[1:]
    last = np.flatnonzero(ends)
    row = np.searchsorted(offsets, first, "right") - 1
    return row, place[first], first, last - first + 1


def _hashes(
    data: np.ndarray, offsets: np.ndarray, row: np.ndarray, place: np.ndarray, first: np.ndarray, count: np.ndarray, length: int
) -> tuple[np.ndarray, np.ndarray]:
    """A 48-bit hash of each run's stretch and the gram's place in it, and 16 bits for each side of the gram.

    A window has ``length`` - 16 bytes beside its gram, so at least half of them on one side: documents that share a
    window have the same gram and the same nearest half on one side at least.
    """
    total, half = prefix_sums(data), _half(length)
    stretch = spans_of(total, first, first + count - 1 + length) + (place - first).astype(np.uint64) * _MULT
    right = spans_of(total, place + GRAM, np.minimum(place + GRAM + half, offsets[row + 1]))
    left = spans_of(total, np.maximum(place - half, offsets[row]), place)
    return mix(stretch) >> np.uint64(16), ((right & np.uint64(0xFFFF)) | (left & np.uint64(0xFFFF0000))).astype(np.uint32)


def _half(length: int) -> int:
    return -(-(length - GRAM) // 2)


def _leading(data: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and the next eight bytes of each suffix as numbers in the order of the bytes."""
    eight = _words_at(data)
    return eight[place].byteswap(), eight[place + 8].byteswap()


def multikey_order(*keys: np.ndarray) -> np.ndarray:
    """The order by the first key, and among equals by the next: only ties are sorted again."""
    order = np.argsort(keys[0], kind="stable")
    if len(keys) == 1 or len(order) < 2:
        return order
    head = keys[0][order]
    tied = np.zeros(len(head), bool)
    tied[1:] = head[1:] == head[:-1]
    among = tied.copy()
    among[:-1] |= tied[1:]
    at = np.flatnonzero(among)
    if len(at):
        group = np.cumsum(~tied)[at]
        inner = multikey_order(*(k[order[at]] for k in keys[1:]))
        inner = inner[np.argsort(group[inner], kind="stable")]
        order[at] = order[at][inner]
    return order


def _planes(values: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane, which compresses sorted and small ones well."""
    return values.view(np.uint8).reshape(len(values), -1).T.tobytes()


def _from_planes(blob: memoryview, n: int, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.frombuffer(blob, np.uint8).reshape(width, n).T.copy().view(kind).ravel()


def _pack(columns: list[np.ndarray]) -> bytes:
    body = b"".join(_planes(np.ascontiguousarray(c)) for c in columns)
    return zstandard.ZstdCompressor(level=1).compress(body)


def _unpack(blob: bytes, kinds: list[str]) -> list[np.ndarray]:
    body = zstandard.ZstdDecompressor().decompress(blob)
    n = len(body) // sum(np.dtype(k).itemsize for k in kinds)
    out, at = [], 0
    for k in kinds:
        size = n * np.dtype(k).itemsize
        out.append(_from_planes(memoryview(body)[at : at + size], n, k))
        at += size
    return out


# lead, next, stretch, sides, document, text hash, first window, windows, place of the gram from the first window, copy
_RUN = ["<u8", "<u8", "<u8", "<u4", "<i8", "<i8", "<u4", "<u2", "<u2", "<u1"]
# A run is sent once, or under a heavy prefix once for each side.
BOTH, RIGHT, LEFT = 0, 1, 2
# document, text hash, gram, first window, windows, role
_FLAG = ["<i8", "<i8", "<u8", "<u4", "<u2", "<u1"]


def _typed(columns: tuple[np.ndarray, ...], kinds: list[str], at: np.ndarray) -> bytes:
    return _pack([c[at].astype(k) for c, k in zip(columns, kinds)])


def _scan(docs: DataFrame, length: int, splitters: np.ndarray, parts: int) -> DataFrame:
    """(kind, bucket, data): kind 0, runs of a bucket of suffixes; 1, settled runs of a part of the documents."""

    def send(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        columns = tuple(np.concatenate(c) for c in zip(*held))
        order = multikey_order(*columns[:3], columns[4])
        columns = tuple(c[order] for c in columns)
        lead, after, stretch, sides, doc, text, first, count, _ = columns
        new = np.ones(len(lead), bool)
        new[1:] = (lead[1:] != lead[:-1]) | (after[1:] != after[:-1]) | (stretch[1:] != stretch[:-1])
        known = doc > doc[np.flatnonzero(new)][np.cumsum(new) - 1]
        keep, gone = np.flatnonzero(~known), np.flatnonzero(known)
        row, bucket, copy = _buckets(lead[keep], after[keep], sides[keep], splitters)
        sent = (*(c[keep[row]] for c in columns), copy)
        out = [(0, b, _typed(sent, _RUN, at)) for b, at in _groups(bucket)]
        settled = (doc, text, np.zeros(len(doc), np.uint64), first, count, np.full(len(doc), SETTLED))
        out += [(1, p, _typed(settled, _FLAG, gone[at])) for p, at in _groups(_part(doc[gone], text[gone], parts))]
        for s in range(0, len(out), 256):
            kind, where, data = zip(*out[s : s + 256])
            yield pa.RecordBatch.from_pydict({"kind": pa.array(kind, pa.int32()), "bucket": pa.array(where, pa.int64()), "data": pa.array(data, pa.binary())})

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            ids, hashes = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for first_row, _, data, offsets in slices(batch.column(2)):
                row, place, first, count = runs(data, offsets, length)
                if not len(row):
                    continue
                stretch, sides = _hashes(data, offsets, row, place, first, count, length)
                held.append((*_leading(data, place), stretch, sides, ids[first_row + row], hashes[first_row + row], first - offsets[row], count, place - first))
                size += len(row)
            if size >= BUFFER_RUNS:
                yield from send(held)
                held, size = [], 0
        if held:
            yield from send(held)

    small_batches(docs.sparkSession)
    return docs.where("doc_id is not null").select("doc_id", "h", "text").mapInArrow(scan, "kind int, bucket long, data binary")


def _groups(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(keys, kind="stable")
    values, starts = np.unique(keys[order], return_index=True)
    for value, a, b in zip(values.tolist(), starts, [*starts[1:], len(order)]):
        yield value, order[a:b]


def _part(doc: np.ndarray, text: np.ndarray, parts: int) -> np.ndarray:
    return (mix(doc.view(np.uint64) + text.view(np.uint64) * _MULT) % np.uint64(parts)).astype(np.int64)


def _side(sides: np.ndarray, copy: int) -> np.ndarray:
    """A number for the nearest bytes on one side of the gram."""
    sides = sides.astype(np.uint64)
    return (sides & np.uint64(0xFFFF)) + np.uint64(1) if copy == RIGHT else (sides >> np.uint64(16)) + np.uint64(1 << 32)


def _buckets(lead: np.ndarray, after: np.ndarray, sides: np.ndarray, splitters: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, bucket, copy) of each suffix sent; a prefix equal to several splitters is spread over their buckets.

    Two splitters or more are a heavy prefix: its suffixes are sent twice, spread by what is on the right and on the left.
    """
    low = np.searchsorted(splitters, lead, "left")
    high = np.searchsorted(splitters, lead, "right")
    width = (high - low + 1).astype(np.uint64)
    heavy = high - low >= 2
    rows, buckets, copies = [], [], []
    for copy, at in ((BOTH, np.flatnonzero(~heavy)), (RIGHT, np.flatnonzero(heavy)), (LEFT, np.flatnonzero(heavy))):
        spread = after[at] + _MULT if copy == BOTH else after[at] + mix(_side(sides[at], copy) * _MULT)
        rows.append(at)
        buckets.append(low[at] + (mix(spread) % width[at]).astype(np.int64))
        copies.append(np.full(len(at), copy, np.uint8))
    return np.concatenate(rows), np.concatenate(buckets), np.concatenate(copies)


def _splitters(docs: DataFrame, length: int, buckets: int, rows: int) -> np.ndarray:
    """Quantiles of the leading bytes of sampled suffixes. They decide where work goes and not what is found.

    Rows are drawn one by one, so copies and rows of one id that fill a third of the table have their share only.
    """
    share = max(1, rows // SAMPLE_DOCS)

    def leads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in slices(batch.column(0)):
                place = runs(data, offsets, length)[1]
                place = place[:: max(SAMPLE_STEP, -(-len(place) // (SAMPLE_MOST * (len(offsets) - 1))))]
                yield pa.RecordBatch.from_pydict({"lead": _leading(data, place)[0].view(np.int64)} if len(place) else {"lead": pa.array([], pa.int64())})

    if buckets < 2:
        return np.zeros(0, np.uint64)
    picked = docs.where(F.rand(7) * share < 1).select("text")
    lead = np.sort(picked.mapInArrow(leads, "lead long").toArrow()["lead"].to_numpy().view(np.uint64))
    return lead[np.linspace(0, len(lead), buckets + 1).astype(int)[1:-1]] if len(lead) >= buckets else lead


def _shared(keys: list[np.ndarray], doc: np.ndarray, settled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of runs with equal keys: those with an earlier document, and those that such a run may have windows of."""
    order = multikey_order(*keys)
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    starts, group = np.flatnonzero(new), np.cumsum(new) - 1
    least = np.minimum.reduceat(doc[order], starts)[group]
    pending = ~settled[order] & (doc[order] > least)
    source = np.logical_or.reduceat(pending, starts)[group] & ~settled[order]
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    return pending[back], source[back]


def _resolved(blocks: DataFrame, parts: int, length: int) -> DataFrame:
    """(bucket, data): the roles, by part of the documents, of the runs that any document shares with an earlier one."""
    # So many bytes before the gram a window may begin and still hold the whole right half.
    reach = length - GRAM - _half(length)

    def resolve(group: pa.Table) -> pa.Table:
        data = group.column("data").to_pylist()
        if group.column("kind")[0].as_py() == 1:
            return pa.table({"bucket": group.column("bucket"), "data": pa.array(data, pa.binary())})
        columns = tuple(np.concatenate(c) for c in zip(*(_unpack(b, _RUN) for b in data)))
        order = multikey_order(*columns[:3], columns[4])
        lead, after, stretch, sides, doc, text, first, count, gram_at, copy = (c[order] for c in columns)
        new = np.ones(len(lead), bool)
        new[1:] = (lead[1:] != lead[:-1]) | (after[1:] != after[:-1]) | (stretch[1:] != stretch[:-1])
        settled = doc > doc[np.flatnonzero(new)][np.cumsum(new) - 1]
        out = []

        def add(keep: np.ndarray, gram: np.ndarray, begin: np.ndarray, windows: np.ndarray, role: np.ndarray) -> None:
            keep = keep & (windows > 0)
            at = np.flatnonzero(keep)
            for p, own in _groups(_part(doc[at], text[at], parts)):
                out.append((p, _typed((doc, text, gram, begin, windows, role), _FLAG, at[own])))

        add(settled & (copy != LEFT), np.zeros(len(doc), np.uint64), first, count, np.full(len(doc), SETTLED))
        # The earlier windows hold the whole left half.
        split = np.clip(gram_at.astype(np.int64) - reach, 0, count.astype(np.int64))
        spans = {RIGHT: (first + split, count - split), LEFT: (first, split)}
        for side, (begin, windows) in spans.items():
            near = _side(sides, side)
            # The first document of each stretch is a source for the pending ones with the same bytes.
            pending, source = _shared([lead, after, near], doc, settled | (copy == (LEFT if side == RIGHT else RIGHT)))
            add(pending | source, mix(mix(lead + mix(after)) + near * _MULT), begin, windows, pending * PENDING + source * SOURCE)
        return pa.table({"bucket": pa.array([p for p, _ in out], pa.int64()), "data": pa.array([d for _, d in out], pa.binary())})

    return blocks.groupBy("kind", "bucket").applyInArrow(resolve, "bucket long, data binary")


def _per_document(flags: DataFrame) -> DataFrame:
    """(doc_id, h, flags): one row per document from the blocks of its part."""

    def split(group: pa.Table) -> pa.Table:
        columns = [np.concatenate(c) for c in zip(*(_unpack(b, _FLAG) for b in group.column("data").to_pylist()))]
        key = mix(columns[0].view(np.uint64)) + columns[1].view(np.uint64)
        docs, texts, data = [], [], []
        for _, at in _groups(key):
            docs.append(int(columns[0][at[0]]))
            texts.append(int(columns[1][at[0]]))
            data.append(_pack([c[at] for c in columns[2:]]))
        return pa.table({"doc_id": pa.array(docs, pa.int64()), "h": pa.array(texts, pa.int64()), "flags": pa.array(data, pa.binary())})

    return flags.groupBy("bucket").applyInArrow(split, "doc_id long, h long, flags binary")


def _windows(texts: DataFrame, length: int) -> DataFrame:
    """(gram, doc_id, h, first, pending, stretch) of the pending runs and sources of texts (doc_id, h, flags, text)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text_hash, flags, text in zip(*(c.to_pylist() for c in batch.columns)):
                gram, first, count, role = _unpack(flags, _FLAG[2:])
                at = np.flatnonzero(role & (PENDING | SOURCE))
                if not len(at):
                    continue
                raw = text.encode()
                stretch = [raw[a : a + c - 1 + length] for a, c in zip(first[at].tolist(), count[at].tolist())]
                yield pa.RecordBatch.from_pydict(
                    {
                        "gram": gram[at].view(np.int64),
                        "doc_id": np.full(len(at), doc, np.int64),
                        "h": np.full(len(at), text_hash, np.int64),
                        "first": first[at].astype(np.int64),
                        "pending": (role[at] & PENDING) > 0,
                        "stretch": pa.array(stretch, pa.binary()),
                    }
                )

    return texts.mapInArrow(cut, "gram long, doc_id long, h long, first long, pending boolean, stretch binary")


def _found(windows: DataFrame, length: int, groups: int) -> DataFrame:
    """(doc_id, h, first): windows of pending runs that an earlier document has, compared byte for byte."""

    def compare(group: pa.Table) -> pa.Table:
        doc = group.column("doc_id").to_numpy()
        first, pending = group.column("first").to_numpy(), group.column("pending").to_numpy()
        stretch = group.column("stretch").to_pylist()
        count = np.array([len(s) for s in stretch]) - length + 1
        run = np.repeat(np.arange(len(stretch)), count)
        data = np.frombuffer(b"".join(stretch), np.uint8)
        begin = np.cumsum([0, *(len(s) for s in stretch[:-1])])
        inner = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
        start = begin[run] + inner
        whole = np.zeros((len(start), -(-length // 8) * 8), np.uint8)
        whole[:, :length] = np.lib.stride_tricks.sliding_window_view(data, length)[start]
        eights = whole.view(">u8").astype(np.uint64)
        order = multikey_order(*eights.T)
        new = np.ones(len(order), bool)
        new[1:] = (eights[order][1:] != eights[order][:-1]).any(axis=1)
        content = np.empty(len(order), np.int64)
        content[order] = np.cumsum(new) - 1
        least = np.full(content.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, content, doc[run])
        hit = np.flatnonzero(pending[run] & (doc[run] > least[content]))
        place = first[run[hit]] + inner[hit]
        return pa.table(
            {
                "doc_id": doc[run[hit]],
                "h": group.column("h").to_numpy()[run[hit]],
                "first": pa.array(place, pa.int64()),
            }
        )

    # Equal windows have equal grams, so any grouping of the grams keeps them together.
    return windows.withColumn("group", F.pmod("gram", F.lit(groups))).groupBy("group").applyInArrow(compare, "doc_id long, h long, first long")


def _laid(flags: bytes | None, extra: list[int] | None, raw: bytes, length: int) -> tuple[int, int, str, bytes]:
    """(bytes removed, removed runs, digest of the rest, the rest) of a text."""
    delta = np.zeros(len(raw) + 1, np.int64)
    if flags is not None:
        _, first, count, role = _unpack(flags, _FLAG[2:])
        at = (role & SETTLED) > 0
        np.add.at(delta, first[at].astype(np.int64), 1)
        np.add.at(delta, first[at].astype(np.int64) + count[at].astype(np.int64) - 1 + length, -1)
    if extra is not None and len(extra):
        place = np.asarray(extra, np.int64)
        np.add.at(delta, place, 1)
        np.add.at(delta, place + length, -1)
    covered = np.cumsum(delta)[:-1] > 0
    edges = np.count_nonzero(covered[1:] & ~covered[:-1]) + int(len(covered) > 0 and covered[0])
    kept = np.frombuffer(raw, np.uint8)[~covered].tobytes()
    return int(covered.sum()), int(edges), hashlib.sha256(kept).hexdigest(), kept


def repeated_bytes(docs: DataFrame, length: int = 50, with_kept: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) for each row of docs (doc_id, text).

    Removed is each byte that lies in a string of ``length`` bytes which also starts in a document of a smaller id.
    """
    if length < GRAM + 1:
        raise ValueError(f"passages have at least {GRAM + 1} bytes")
    spark = docs.sparkSession
    small_batches(spark)
    text = F.coalesce("text", F.lit(""))
    ids = F.col("doc_id").cast("long").alias("doc_id")
    # Rows of one id are told apart by a hash of the text, where there are such rows.
    same = docs.select(ids, F.xxhash64(text).alias("h")).groupBy("doc_id").agg((F.min("h") != F.max("h")).alias("differ"))
    mixed = same.agg(F.bool_or("differ")).first()[0]
    texts = docs.select(ids, (F.xxhash64(text) if mixed else F.lit(0).cast("long")).alias("h"), text.alias("text"))
    rows, size = texts.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    buckets = max(1, -(-size // BUCKET_BYTES))
    splitters = _splitters(texts, length, buckets, rows)
    flags = _resolved(_scan(texts, length, splitters, buckets), buckets, length)
    per_doc = written(_per_document(flags), "flags").withColumnRenamed("doc_id", "key")
    # One exchange of the texts serves both joins; the key is never null, so that both ask for the same rows.
    keyed = texts.withColumn("key", F.coalesce("doc_id", F.lit(-(2**63)).cast("long")))
    some = keyed.select("key", "h", "text").join(per_doc, ["key", "h"]).select("key", "h", "flags", "text")
    found = _found(_windows(some, length), length, 4 * buckets)
    found = found.groupBy(F.col("doc_id").alias("key"), "h").agg(F.collect_list("first").alias("extra"))
    marks = per_doc.join(found, ["key", "h"], "left")
    marked = keyed.join(marks, ["key", "h"], "left").select(
        "doc_id", "flags", "extra", F.when(F.col("flags").isNotNull() & F.col("doc_id").isNotNull(), F.col("text")).alias("cut"), F.col("text").alias("text")
    )
    plain = F.sha2(F.encode("text", "UTF-8"), 256)
    marked = marked.select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "flags", "extra", "cut", F.when(F.col("cut").isNull(), plain).alias("plain"),
        *([F.when(F.col("cut").isNull(), F.col("text")).alias("whole")] if with_kept else []),
    )

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            kept = batch.column("whole").cast(pa.binary()).to_pylist() if with_kept else None
            for i, (f, e, cut, plain) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("flags", "extra", "cut", "plain")))):
                if cut is None:
                    out.append((0, 0, plain))
                    continue
                removed, spans, digest, rest = _laid(f, e, cut.encode(), length)
                out.append((removed, spans, digest))
                if with_kept:
                    kept[i] = rest
            removed, spans, digest = zip(*out) if out else ((), (), ())
            columns = {
                "doc_id": batch.column("doc_id"), "n_bytes": batch.column("n_bytes"), "n_removed": pa.array(removed, pa.int64()),
                "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(digest, pa.string()),
            }
            if with_kept:
                columns["kept"] = pa.array(kept, pa.binary())
            yield pa.RecordBatch.from_pydict(columns)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_kept else "")
    return marked.mapInArrow(lay, schema)
