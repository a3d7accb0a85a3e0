"""Words and n-gram hashes of a column of texts, computed on its bytes with NumPy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
# Texts are taken together up to so many bytes; a longer text is taken alone.
SLICE_BYTES = 2_000_000
# Where every word gets several numbers, memory is some fifty times the bytes; workers keep it while others run.
WORDS_SLICE_BYTES = 400_000
# The white space of words: space, tab, line feed, vertical tab, form feed, carriage return.
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, name: str, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[name] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, next row, bytes, offsets) of neighbouring texts; nulls are empty texts."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    n = len(texts)
    if not n:
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each word; a word never crosses a row."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    solid = ~_SPACE[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    begins[inner] = solid[inner]
    ends[inner - 1] = solid[inner - 1]
    start = np.flatnonzero(begins)
    end = np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z become a-z; other bytes stay."""
    return _LOWER[data]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """What ``spans_of`` needs of the bytes."""
    total = np.zeros(len(data) + 1, np.uint64)
    if len(data):
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(_BASE, "base", len(data)), out=total[1:])
    return total


def spans_of(total: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of the bytes whose ``prefix_sums`` these are."""
    value = (total[end] - total[start]) * _power(_BASE_INVERSE, "inverse", len(total))[start]
    return mix(value + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, in time of the bytes and not of the spans' lengths."""
    return spans_of(prefix_sums(data), start, end)


def shingles(word: np.ndarray, row: np.ndarray, rows: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of the distinct shingles, sorted by row and hash.

    A row of fewer words than ``width`` has its whole sequence as the one shingle, a row without words none.
    """
    count = np.bincount(row, minlength=rows)
    mult = np.uint64(0xA24BAED4963EE407)
    n = len(word)
    if n >= width:
        value = word[: n - width + 1].copy()
        for k in range(1, width):
            value = mix(value * mult + word[k : n - width + 1 + k])
        whole = row[: n - width + 1] == row[width - 1 :]
        value, owner = value[whole], row[: n - width + 1][whole]
    else:
        value, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        first = np.searchsorted(row, short)
        extra = np.zeros(len(short), np.uint64)
        for i, (r, f) in enumerate(zip(short, first)):
            x = word[f : f + 1].copy()
            for k in range(1, count[r]):
                x = mix(x * mult + word[f + k : f + k + 1])
            extra[i] = mix(x + np.uint64(count[r]))[0]
        value = np.concatenate([value, extra])
        owner = np.concatenate([owner, short])
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    keep = np.ones(len(value), bool)
    keep[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    return value[keep], owner[keep]


def text_shingles(texts: pa.Array, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, hash, row) for slices of the texts; words are lower-cased in A-Z."""
    for first, end, data, offsets in slices(texts, WORDS_SLICE_BYTES):
        data = lower(data)
        start, stop, row = spans(data, offsets)
        value, owner = shingles(span_hashes(data, start, stop), row, end - first, width)
        yield first, end - first, value, owner
