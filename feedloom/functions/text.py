"""Text cleaning as Column -> Column functions."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# White space as Python's ``\s`` defines it for str. Java needs the
# Unicode flag and the four separators U+001C to U+001F on top.
SPACE = r"\s\x1c-\x1f"
# What the cleaner removes.
URL_PATTERN = rf"(?U)https?://[^{SPACE}]+"
EMOJI_PATTERN = (
    r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}]+"
)
REPOST_PATTERN = r"^RT @[^:]+: "
# URLs and emoji in one pass. No URL starts inside an emoji run and none can arise by
# removing one, so this equals removing first the URLs and then the emoji. The wide
# range is tested before the blocks.
URL_OR_EMOJI_PATTERN = URL_PATTERN + r"|[\x{10000}-\x{10FFFF}&&" + EMOJI_PATTERN[:-1] + "]+"
SPACE_PATTERN = rf"(?U)[{SPACE}]+"

# Blocks whose characters NFC leaves alone and which never compose with a
# neighbour (checked against unicodedata in the tests). Text made of these only
# needs no normalisation.
NFC_SAFE_BLOCKS = (
    (0x0000, 0x02FF),
    (0x0400, 0x0482),
    (0x048A, 0x052F),
    (0x2010, 0x2027),
    (0x2030, 0x205E),
    (0x20A0, 0x20BF),
    (0x3041, 0x3096),
    (0x30A1, 0x30FA),
    (0x4E00, 0x9FFF),
    (0xAC00, 0xD7A3),
    (0xFE0F, 0xFE0F),
    (0x1F300, 0x1FAFF),
)
_SAFE = "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in NFC_SAFE_BLOCKS)
# The first range is tested first and most characters fail it.
NFC_UNSAFE = rf"[\x{{300}}-\x{{10FFFF}}&&[^{_SAFE}]]"


def as_column(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


@F.arrow_udf(T.StringType())
def _compose(values: pa.Array) -> pa.Array:
    # Arrow's own utf8_normalize leaves NFC text decomposed, hence unicodedata.
    # One text at a time is a Python string, of up to four bytes a sign; the others stay UTF-8.
    composed = [unicodedata.normalize("NFC", v.as_py()).encode() if v.is_valid else None for v in values]
    return pa.array(composed, pa.string())


def nfc(col: Column | str) -> Column:
    """Unicode NFC. Only rows that can change travel to Python; the rest go as NULL."""
    c = as_column(col)
    return F.coalesce(_compose(F.when(c.rlike(NFC_UNSAFE), c)), c)


def strip_urls(col: Column | str) -> Column:
    return F.regexp_replace(as_column(col), URL_PATTERN, "")


def strip_emoji(col: Column | str) -> Column:
    return F.regexp_replace(as_column(col), EMOJI_PATTERN, "")


def strip_rt_prefix(col: Column | str) -> Column:
    c = as_column(col)
    return F.when(c.startswith("RT @"), F.regexp_replace(c, REPOST_PATTERN, "")).otherwise(c)


def collapse_whitespace(col: Column | str) -> Column:
    return F.trim(F.regexp_replace(as_column(col), SPACE_PATTERN, " "))


def normalize_text(col: Column | str) -> Column:
    """NFC, then URLs, emoji, repost marker and white space, in this order."""
    bare = F.regexp_replace(nfc(col), URL_OR_EMOJI_PATTERN, "")
    return collapse_whitespace(strip_rt_prefix(bare))


def first_tokens(col: Column | str, max_tokens: int) -> Column:
    """First ``max_tokens`` tokens of text whose white space is already collapsed."""
    return F.substring_index(as_column(col), " ", max_tokens)


def truncate_tokens(col: Column | str, max_tokens: int) -> Column:
    """Text unchanged when it has at most ``max_tokens`` tokens, else those tokens."""
    if max_tokens < 1:
        raise ValueError("max_tokens must be at least 1")
    c = as_column(col)
    flat = collapse_whitespace(c)
    cut = first_tokens(flat, max_tokens)
    return F.when(cut == flat, c).otherwise(cut)


def ensure_max_length(col: Column | str, max_length: int) -> Column:
    if max_length < 1:
        raise ValueError("max_length must be at least 1")
    c = as_column(col)
    return F.when(F.length(c) <= max_length, c).otherwise(
        F.concat(F.substring(c, 1, max_length - 1), F.lit("…"))
    )


def first_nonempty(*cols: Column | str) -> Column:
    """First column that is neither NULL nor empty, else the empty string."""
    return F.coalesce(*[F.nullif(as_column(c), F.lit("")) for c in cols], F.lit(""))


def clean_post(col: Column | str, max_tokens: int | None = None) -> Column:
    """Cleaned text; it is whole unless a limit is asked for."""
    clean = normalize_text(col)
    return clean if max_tokens is None else first_tokens(clean, max_tokens)


def content_hash(source: Column | str, text: Column | str) -> Column:
    """Hex SHA-256 of ``source::text``, so equal texts of two sources differ."""
    return F.sha2(F.concat(as_column(source), F.lit("::"), as_column(text)), 256)


def split_list(col: Column | str) -> Column:
    """Comma list to array; items are not trimmed."""
    return F.split(as_column(col), ",")
