"""Near duplicates of word shingles: SuperMinHash signatures, banding, verification on full sets, union-find.

SuperMinHash gives each shingle a random permutation of the registers and the values 0 + r, 1 + r', ... along it.
A register keeps its least value, and a shingle stops once its next value exceeds every register, so a long
document needs about one step per shingle and the registers of a document are less alike than independent ones.
With 16 bands of 4 registers, two sets of similarity 0.85 share no band with a probability of 7e-6.

Equal sets (a 128-bit key) are one node. In each bucket of a band the member that most other documents
collide with leads and is compared with the rest, which links most of a group of copies in as many pairs as it has
members. What is left are buckets whose members are not yet of one component. Two linked sets share so many
shingles that one of their rarest is common, so there only members of different components that share such a prefix shingle are
compared. That misses no link, has no cap, and holds no group in one task: a variant with too many shingles of its own meets nobody,
and members of one component never meet.

Defined results: words are split at ASCII white space, A-Z in lower case; fewer words than ``width`` are one
shingle; null, empty and blank texts have none, link with nothing and are kept, as are rows without id; rows of one
id are one document, linked as any of them; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedloom.llm.common import connected_components, having_key, row_key, small_batches, written
from feedloom.llm.words import mix, text_shingles

BANDS, BAND_ROWS = 16, 4
_STEP = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64(0xFFFFFFFF)
_HALF = np.uint64(32)


def super_minhash(value: np.ndarray, owner: np.ndarray, rows: int, registers: int) -> np.ndarray:
    """(rows, registers) signatures of the sets given as (element hash, row) pairs.

    A register holds step * 2^32 + fraction; rows without elements hold the largest number.
    """
    top = np.uint64(registers) << _HALF
    sig = np.full(rows * registers, top | _LOW, np.uint64)
    live, at, perm = value, owner, None
    for step in range(registers):
        if not len(live):
            break
        random = mix(live + np.uint64((step + 1) * int(_STEP) % 2**64))
        swap = step + (((random >> _HALF) * np.uint64(registers - step)) >> _HALF).astype(np.int64)
        if perm is None:
            register = swap
        else:
            each = np.arange(len(live))
            register = perm[each, swap].astype(np.int64)
            perm[each, swap] = perm[:, step]
        code = (np.uint64(step) << _HALF) | (random & _LOW)
        np.minimum.at(sig, at * registers + register, code)
        highest = (sig.reshape(rows, registers).max(axis=1) >> _HALF).astype(np.int64)
        going = highest[at] > step
        if perm is None:
            kept = int(going.sum())
            perm = np.tile(np.arange(registers, dtype=np.uint16 if registers > 256 else np.uint8), (kept, 1))
            perm[np.arange(kept), swap[going]] = 0
        else:
            perm = perm[going]
        live, at = live[going], at[going]
    return sig.reshape(rows, registers)


def band_hashes(sig: np.ndarray, bands: int) -> np.ndarray:
    """(rows, bands) hashes of the bands, the band's number included."""
    parts = sig.reshape(len(sig), bands, -1)
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _STEP, parts.shape[:2]).copy()
    for k in range(parts.shape[2]):
        out = mix(out + parts[:, :, k])
    return out


def signed_documents(docs: DataFrame, width: int, bands: int, band_rows: int) -> DataFrame:
    """(doc_id, n_shingles, key_a, key_b, bands) of each document (doc_id, text)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, rows, value, owner in text_shingles(batch.column(1), width):
                count = np.bincount(owner, minlength=rows)
                key_a, key_b = np.zeros(rows, np.uint64), np.zeros(rows, np.uint64)
                np.add.at(key_a, owner, mix(value ^ _STEP))
                np.add.at(key_b, owner, mix(mix(value) + _STEP))
                hashes = band_hashes(super_minhash(value, owner, rows, bands * band_rows), bands)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column(0).slice(first, rows),
                        "n_shingles": pa.array(count.astype(np.int64)),
                        "key_a": pa.array(key_a.view(np.int64)),
                        "key_b": pa.array(key_b.view(np.int64)),
                        "bands": pa.ListArray.from_arrays(np.arange(0, (rows + 1) * bands, bands, dtype=np.int32), hashes.ravel().view(np.int64)),
                    }
                )

    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(sign, f"doc_id {kind}, n_shingles long, key_a long, key_b long, bands array<long>")


def _distinct_sets(texts: DataFrame, width: int) -> DataFrame:
    """(doc_id, key, text): one row for each shingle set of an id, however often and in whatever spelling it is repeated."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, rows, value, owner in text_shingles(batch.column(1), width):
                key = np.zeros(rows, np.uint64)
                np.add.at(key, owner, mix(value ^ _STEP))
                part = batch.slice(first, rows)
                yield pa.RecordBatch.from_pydict({"doc_id": part.column(0), "key": pa.array(key.view(np.int64)), "text": part.column(1)})

    kind = texts.schema["doc_id"].dataType.simpleString()
    rows = texts.select("doc_id", "text").mapInArrow(keyed, f"doc_id {kind}, key long, text string")
    return rows.groupBy("doc_id", "key").agg(F.min("text").alias("text"))


def _ordered(doc: str, key: str, other: str, other_key: str) -> list:
    """Columns (u, ku, v, kv): two documents and the keys of their sets, the smaller document first."""
    a, b = F.struct(F.col(doc).alias("d"), F.col(key).alias("k")), F.struct(F.col(other).alias("d"), F.col(other_key).alias("k"))
    low, high = F.least(a, b), F.greatest(a, b)
    return [low["d"].alias("u"), low["k"].alias("ku"), high["d"].alias("v"), high["k"].alias("kv")]


def _verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """(u, v) of the pairs (u, ku, v, kv) whose full sets have 100 * shared >= percent * together."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        @lru_cache(maxsize=64)
        def of(text: str | None) -> np.ndarray:
            return next(iter(text_shingles(pa.array([text], pa.string()), width)))[2]

        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = of(a), of(b)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared) and shared > 0)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], names=["u", "v"])

    kind = pairs.schema["u"].dataType.simpleString()
    left = texts.select(F.col("doc_id").alias("u"), F.col("key").alias("ku"), F.col("text").alias("text_u"))
    right = texts.select(F.col("doc_id").alias("v"), F.col("key").alias("kv"), F.col("text").alias("text_v"))
    both = pairs.join(right, ["v", "kv"]).join(left, ["u", "ku"]).select("u", "v", "text_u", "text_v")
    return both.mapInArrow(compare, f"u {kind}, v {kind}").distinct()


def _leaders(members: DataFrame) -> DataFrame:
    """(band, leader, n_leader, key_leader): the member of each bucket that most documents collide with."""
    best = members.groupBy("band").agg(F.max(F.struct("popular", (-F.col("doc")).alias("last"), "doc", "n", "key")).alias("m"))
    return best.select("band", F.col("m.doc").alias("leader"), F.col("m.n").alias("n_leader"), F.col("m.key").alias("key_leader"))


def _prefix_pairs(members: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """(u, ku, v, kv): members (doc, comp) of different components that share one of the rarest shingles of both.

    Shingles are counted and ranked per set (doc, key), so repeated rows and other texts of an id change nothing.
    """

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, rows, value, owner in text_shingles(batch.column(2), width):
                docs, keys = (batch.column(c).slice(first, rows).take(pa.array(owner)) for c in (0, 1))
                n = np.bincount(owner, minlength=rows)[owner]
                for i in range(0, len(value), 100_000):
                    j = slice(i, i + 100_000)
                    yield pa.RecordBatch.from_pydict({"doc": docs[j], "key": keys[j], "n": n[j].astype(np.int32), "s": value[j].view(np.int64)})

    kind = members.schema["doc"].dataType.simpleString()
    own = texts.join(members.select(F.col("doc").alias("doc_id")), "doc_id", "left_semi").select("doc_id", "key", "text")
    shingles = written(own.mapInArrow(explode, f"doc {kind}, key long, n int, s long"), "shingles")
    often = written(shingles.groupBy("s").agg(F.count("*").alias("df")), "often")
    by_doc = Window.partitionBy("doc", "key")
    rank = F.row_number().over(by_doc.orderBy("df", "s"))
    length = F.col("n") - F.ceil(F.col("n") * percent / F.lit(100)) + 1
    # What no other member has counts against any link: at most the rest can be shared.
    rest = F.col("n") - F.count_if(F.col("df") == 1).over(by_doc)
    prefix = shingles.join(often, "s").withColumns({"rank": rank, "rest": rest}).where((F.col("rank") <= length) & (F.col("df") > 1))
    prefix = written(prefix.select("s", "doc", "key", "n", "rest", "rank").join(members, "doc"), "prefix")
    # Per shingle, the members of the component that has most of them meet only the others.
    most = prefix.groupBy("s", "comp").count().groupBy("s").agg(F.max(F.struct("count", "comp")).alias("m")).select("s", F.col("m.comp").alias("main"))
    most = written(most, "most")
    few = prefix.join(most, "s").where("comp <> main").select("s", F.col("doc").alias("a"), F.col("key").alias("key_a"), F.col("n").alias("n_a"), F.col("rest").alias("rest_a"), F.col("rank").alias("rank_a"), F.col("comp").alias("comp_a"))
    # Two sets of n and n_a shingles share at least this many if they are linked, so one of their first n - needed + 1.
    needed = f"ceil({percent} * (n + n_a) / {100 + percent})"
    met = written(few, "few").join(prefix, "s").where(
        f"comp <> comp_a and least(rest, rest_a) >= {needed} and least(n - rank, n_a - rank_a) >= {needed} - 1"
    )
    return met.select(*_ordered("a", "key_a", "doc", "key")).distinct()


def near_duplicates(
    docs: DataFrame, percent: int = 85, width: int = 5, bands: int = BANDS, band_rows: int = BAND_ROWS
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs (doc_id, text).

    Documents are linked whose shingle sets have 100 * intersection >= percent * union.
    """
    signed = written(signed_documents(docs, width, bands, band_rows), "signed")
    keys = ["key_a", "key_b", "n_shingles"]
    usable = signed.where("n_shingles > 0 and doc_id is not null")
    nodes = written(usable.groupBy(*keys).agg(F.min("doc_id").alias("doc"), F.first("bands").alias("bands")), "nodes")
    rows = nodes.select(F.explode("bands").alias("band"), "doc", F.col("n_shingles").alias("n"), F.col("key_a").alias("key"))
    buckets = written(rows.groupBy("band").agg(F.count("*").alias("size")).where("size > 1"), "buckets")
    members = written(rows.join(buckets, "band"), "members")
    popular = members.groupBy("doc").agg(F.sum("size").alias("popular"))
    live = written(members.join(popular, "doc").select("band", "doc", "n", "key", "popular"), "live")
    # The ids have no proven bound: joined by a shuffle at every size.
    wanted = popular.select(F.col("doc").alias("doc_id")).hint("merge")
    texts = docs.select("doc_id", "text").join(wanted, "doc_id", "left_semi")
    texts = written(_distinct_sets(texts, width), "texts")
    leaders = written(_leaders(live), "leaders")
    pairs = (
        leaders.join(live, "band")
        .where(f"doc <> leader and 100 * least(n, n_leader) >= {percent} * greatest(n, n_leader)")
        .select(*_ordered("leader", "key_leader", "doc", "key"))
        .distinct()
    )
    edges = written(_verified(written(pairs, "pairs"), texts, width, percent), "links")
    first = written(connected_components(edges), "first").withColumnRenamed("node", "doc")
    grouped = live.join(first, "doc", "left").select("band", "doc", F.coalesce("component", "doc").alias("comp"))
    grouped = written(grouped, "grouped")
    unsettled = grouped.groupBy("band").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high")
    rest = grouped.join(unsettled.select("band"), "band", "left_semi").select("doc", "comp").distinct()
    more = written(_prefix_pairs(written(rest, "rest"), texts, width, percent), "more-pairs")
    edges = edges.unionByName(written(_verified(more, texts, width, percent), "more-links"))
    components = written(connected_components(edges), "components")
    by_key = nodes.select(*keys, "doc").join(components.withColumnRenamed("node", "doc"), "doc", "left")
    by_key = written(by_key.select(*keys, F.coalesce("component", "doc").alias("component_id")), "classes")
    return (
        signed.select("doc_id", *keys)
        .join(by_key, keys, "left")
        .select(
            "doc_id",
            "n_shingles",
            F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def without_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """docs, of each group of near duplicates only the document with the smallest id. Rows without id stay."""
    kept = near_duplicates(docs, **options).where("kept and doc_id is not null").select("doc_id").distinct()
    one = docs.where("doc_id is not null").join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return one.unionByName(docs.where("doc_id is null"))


def one_of_each_group(docs: DataFrame, **options) -> DataFrame:
    """docs, of each group of near duplicates only the text with the smallest id; rows without id come last.

    Each text of an id is judged by itself, and rows without id as well. Rows of equal id and text count as one; rows
    without id and without words all stay.
    """
    units = docs.select(row_key().alias("doc_id"), "doc_id", "text").toDF("unit", "doc_id", "text")
    parts = near_duplicates(units.select(F.col("unit").alias("doc_id"), "text"), **options)
    parts = written(parts.select(F.col("doc_id").alias("unit"), "component_id").distinct(), "unit-groups")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "unit")
    wordless = F.col("doc_id").isNull() & ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    rows = units.groupBy("unit").agg(F.min("doc_id").alias("doc_id"), F.count_if(~wordless).alias("n"))
    rows = written(rows.join(parts, "unit"), "unit-rows")
    # The first of each group is found by an aggregate and met by its own key, so a large group is in no one task.
    firsts = rows.groupBy("component_id").agg(F.min(order).alias("m")).select(F.col("m.unit").alias("unit"), F.lit(True).alias("kept"))
    judged = rows.join(firsts, "unit", "left").select(F.col("unit").alias("k"), "n", F.coalesce("kept", F.lit(False)).alias("kept"))
    judged = written(judged, "judged")
    # Most rows are the only one of their text and no near copy: they stay where they are.
    alone = having_key(docs, row_key(), judged.where("not kept or n > 1").select("k"), keep=False)
    # Of repeated rows the one of the least hash of all columns, so a replay keeps the same.
    repeated = having_key(docs, row_key(), judged.where("kept and n > 1").select("k")).groupBy(row_key().alias("_unit"))
    one = repeated.agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("_row")).select("_row.*")
    return alone.unionByName(one)
