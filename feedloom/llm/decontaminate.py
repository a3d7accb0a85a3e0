"""Benchmark items inside documents: containment MinHash per size class, then exact containment. SQL functions only.

The sets of a short item and of a long document have a Jaccard index near zero whatever the item's share in
the document, so signatures of whole documents cannot tell. The signature is therefore taken of the item alone:
under each permutation, the shingle of least rank. The share of these minima that a document holds estimates
how much of the item it contains, for documents of any length. Items are partitioned by size: up to
``permutations`` shingles the signature is the whole set and the search is exact; above, ``min_hits`` of the
minima must occur, which an item contained to 0.8 misses with a probability of about 2e-12. Items shorter than
a shingle form classes of their own width.

Defined results: words are split at ASCII white space after lower-casing; null, empty and blank texts have no shingle
and never match; an item of fewer than ``width`` words is one shingle of all of them; rows without id are passed
over; repeated rows count once; other columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import having_key, written

BLANKS = " \t\n\x0b\x0c\r"
# A signature table is broadcast in slices of about so many rows (28 bytes each, ids of texts aside).
BROADCAST_ROWS = 1_000_000


def words_of(text: Column) -> Column:
    clean = F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(BLANKS))
    return F.when(clean == "", F.array().cast("array<string>")).otherwise(F.split(clean, "[ \t\n\x0b\x0c\r]+"))


def shingles_of(words: str, width: int, hashed: bool) -> Column:
    """The runs of ``width`` words of an array column; none if it is shorter."""
    parts = ", ".join(f"{words}[i + {k}]" for k in range(width))
    each = f"xxhash64({parts})" if hashed else f"concat_ws(' ', {parts})"
    return F.expr(
        f"if(size({words}) >= {width}, transform(sequence(0, size({words}) - {width}), i -> {each}), "
        f"cast(array() as array<{'bigint' if hashed else 'string'}>))"
    )


def item_shingles(items: DataFrame, width: int) -> DataFrame:
    """(item_id, key, width, shingles) with the distinct shingles as texts; ``key`` tells texts of one id apart."""
    rows = items.where("item_id is not null").select("item_id", words_of(F.col("text")).alias("w")).where("size(w) > 0")
    short = F.least(F.size("w"), F.lit(width))
    own = F.when(F.size("w") < width, F.array(F.array_join("w", " "))).otherwise(F.array_distinct(shingles_of("w", width, False)))
    return rows.select("item_id", short.alias("width"), own.alias("shingles")).select(
        "item_id", F.xxhash64("shingles").alias("key"), "width", "shingles"
    )


def signatures(items: DataFrame, permutations: int, min_hits: int, threshold: float) -> DataFrame:
    """(width, item_id, key, needed, s): the shingles to search for, and how many of an item's a document must hold."""
    count = F.size("shingles")
    exact = items.where(count <= permutations).select(
        "width", "item_id", "key", F.ceil(F.round(F.lit(threshold) * count, 9)).cast("int").alias("needed"), F.explode("shingles").alias("s")
    )
    minima = items.where(count > permutations).select("width", "item_id", "key", F.explode("shingles").alias("s"))
    picks = F.array(*[F.min_by("s", F.struct(F.xxhash64("s", F.lit(i)), F.col("s"))) for i in range(permutations)])
    minima = minima.groupBy("width", "item_id", "key").agg(picks.alias("picks")).select(
        "width", "item_id", "key", F.least(F.size(F.array_distinct("picks")), F.lit(min_hits)).alias("needed"),
        F.explode(F.array_distinct("picks")).alias("s"),
    )
    return exact.unionByName(minima)


def word_hash(shingle: Column, width: int) -> Column:
    """The hash that a document's shingle of this width has."""
    parts = F.split(shingle, " ")
    return F.xxhash64(*[parts[k] for k in range(width)])


def contained_items(
    docs: DataFrame,
    items: DataFrame,
    threshold: float = 0.8,
    width: int = 5,
    permutations: int = 24,
    min_hits: int = 4,
) -> DataFrame:
    """(doc_id, item_id, n_item_shingles, n_shared, containment) of the pairs with containment >= threshold."""
    sets = written(item_shingles(items, width), "items")
    widths = sorted(r[0] for r in sets.select("width").distinct().collect())  # at most ``width`` numbers
    wanted = signatures(sets, permutations, min_hits, threshold)
    h = F.lit(None).cast("long")
    for w in widths:
        h = F.when(F.col("width") == w, word_hash(F.col("s"), w)).otherwise(h)
    wanted = written(wanted.select(h.alias("h"), "item_id", "key", "needed"), "signatures")
    texts = docs.where("doc_id is not null").select("doc_id", "text")
    # One pass over the texts for all widths: hashes of other widths are other numbers.
    each = [shingles_of("w", w, True) for w in widths] or [F.array().cast("array<bigint>")]
    hashes = texts.select("doc_id", words_of(F.col("text")).alias("w")).select("doc_id", F.explode(F.concat(*each)).alias("h"))
    # All of an item's shingles are in one slice; a slice is small enough to be broadcast.
    slices = max(1, -(-wanted.count() // BROADCAST_ROWS))
    found = None
    for i in range(slices):
        own = wanted.where(F.pmod(F.xxhash64("item_id", "key"), F.lit(slices)) == i)
        hits = hashes.join(F.broadcast(own), "h").groupBy("doc_id", "item_id", "key", "needed").agg(F.count_distinct("h").alias("n"))
        hits = hits.where("n >= needed").select("doc_id", "item_id", "key")
        found = hits if found is None else found.unionByName(hits)
    found = written(found, "candidates")
    # Only the texts of candidates move to meet their items.
    pairs = found.join(sets, ["item_id", "key"])
    few = having_key(texts, F.xxhash64("doc_id"), found.select(F.xxhash64("doc_id").alias("k")).distinct())
    checked = pairs.join(few, "doc_id").select(
        "doc_id", "item_id", "shingles", "width", words_of(F.col("text")).alias("w")
    )
    shared = None
    for w in widths:
        one = F.size(F.array_intersect("shingles", shingles_of("w", w, False)))
        shared = F.when(F.col("width") == w, one) if shared is None else shared.when(F.col("width") == w, one)
    # Of texts of one id, the best contained one counts.
    counted = checked.select(
        "doc_id", "item_id", F.size("shingles").cast("long").alias("n_item_shingles"), (F.lit(0) if shared is None else shared).cast("long").alias("n_shared")
    ).groupBy("doc_id", "item_id").agg(
        F.max(F.struct((F.col("n_shared") / F.col("n_item_shingles")).alias("c"), "n_item_shingles", "n_shared")).alias("m")
    ).select("doc_id", "item_id", "m.n_item_shingles", "m.n_shared")
    # threshold as a ratio of whole numbers: no rounding at the boundary
    return counted.withColumn("containment", F.col("n_shared") / F.col("n_item_shingles")).where(
        F.col("n_shared") >= F.ceil(F.round(F.lit(threshold) * F.col("n_item_shingles"), 9))
    )
