"""Upserts and the item store against a plain Python model."""

from __future__ import annotations

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from feedloom.operators import merge
from feedloom.operators.dedup import attach_cached
from feedloom.schemas import ITEMS, LABELS, PAYLOAD
from feedloom.sources.store import ItemStore, VectorCache, create_items_table, declare_items, lookup_by_source_id

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
BATCH = "source string, source_id string, text string, published_at timestamp, sentiment int, stance string, impact int, topics array<string>, embedding array<float>, raw string, content_hash string"


def batch(rng, n):
    """Rows in upsert order; one key is hot, some classifications failed."""
    rows = []
    still = rng.random() < 0.5  # a batch that mostly repeats itself
    for i in range(n):
        key = "hot" if rng.random() < 0.34 else f"k{rng.randint(0, 12)}"
        known = rng.random() < 0.7
        if still and i % 5:
            rows.append((*rows[-1][:-1], f"{i:04d}"))
            continue
        rows.append(
            (
                rng.choice(["reddit", "twitter"]), key, f"text {rng.randint(0, 1)}", T0 + timedelta(seconds=rng.randint(0, 1)),
                rng.choice([-1, 1]) if known else None, "bullish" if known else None, 1 if known else None,
                ["crypto"] if known else [], [float(rng.randint(0, 1))], "{}", f"{i:04d}",
            )
        )
    return sorted(rows, key=lambda r: (r[3], r[-1]))


def payload_of(row):
    source, key, text, at, sentiment, stance, impact, topics, embedding, raw, _ = row
    return {"source": source, "source_id": key, "text": text, "published_at": at, "sentiment": sentiment, "stance": stance, "impact": impact, "topics": topics, "embedding": embedding, "raw": raw}


def apply(table, rows, at, key, keep=False):
    """Sequential upserts, row by row."""
    for row in rows:
        new = payload_of(row)
        k = tuple(new[c] for c in key)
        old = table.get(k)
        if old is None:
            table[k] = {"row": new, "created": at, "updated": at}
            continue
        if keep and new["impact"] is None and old["row"]["impact"] is not None:
            new |= {c: old["row"][c] for c in ("sentiment", "stance", "impact", "topics")}
        if new != old["row"]:
            old["updated"] = at
        old["row"] = new


def utc(value):
    return value.replace(tzinfo=None) if value.tzinfo else value


def seen(df):
    out = {}
    for r in df.select("*", F.col("created_at").cast("string").alias("c"), F.col("updated_at").cast("string").alias("u"), F.col("published_at").cast("string").alias("p")).collect():
        out[(r.source, r.source_id)] = (r.text, r.p, r.sentiment, r.topics, r.embedding, r.c, r.u)
    return out


def wanted(table):
    return {
        (v["row"]["source"], v["row"]["source_id"]): (
            v["row"]["text"], str(utc(v["row"]["published_at"])), v["row"]["sentiment"], v["row"]["topics"],
            v["row"]["embedding"], str(utc(v["created"])), str(utc(v["updated"])),
        )
        for v in table.values()
    }


@pytest.mark.parametrize("key", [("source", "source_id"), ("source_id",)])
@pytest.mark.parametrize("keep", [False, True])
def test_upsert_equals_sequential(spark, key, keep):
    rng = random.Random(5)
    fields = [c for c in PAYLOAD if c in BATCH]
    table, current = {}, None
    for step in range(5):
        rows = batch(rng, 14)
        at = T0 + timedelta(days=step)
        apply(table, rows, at, key, keep)
        df = spark.createDataFrame(rows, BATCH).repartition(3)
        # the label struct needs all label columns
        df = df.withColumns({c: F.lit(None).cast(ITEMS[c].dataType) for c in LABELS if c not in df.columns})
        current = merge.upsert(current, df, F.lit(at), key, [*fields, *[c for c in LABELS if c not in fields]], ("published_at", "content_hash"), keep)
        current = spark.createDataFrame(current.collect(), current.schema)
    assert seen(current) == wanted(table)
    assert current.select("id").distinct().count() == len(table)


@pytest.mark.parametrize("keep", [False, True])
def test_store_equals_sequential(spark, tmp_path, keep):
    """Appended batches, with and without compaction in between, and a replayed batch."""
    rng = random.Random(11)
    store = ItemStore(spark, str(tmp_path / "items"), keep_existing_on_null=keep)
    table = {}
    assert store.current().count() == 0 and store.compact() == -1
    for step in range(6):
        at = T0 + timedelta(days=step)
        for source in ("reddit", "twitter"):
            rows = [r for r in batch(rng, 12) if r[0] == source]
            apply(table, rows, at, ("source", "source_id"), keep)
            key = f"s0-{step:012d}"
            store.append(spark.createDataFrame(rows, BATCH), source, key, at)
            store.append(spark.createDataFrame(rows, BATCH), source, key, at)
        if step in (1, 3):
            assert store.compact() == step // 2
        assert seen(store.current()) == wanted(table)
    assert store.compact() == 2 and store.compact() == 2
    assert seen(store.current()) == wanted(table)
    assert store.current().columns == ITEMS.fieldNames()


def test_batch_without_commit_is_invisible(spark, tmp_path):
    store = ItemStore(spark, str(tmp_path / "items"))
    store.append(spark.createDataFrame(batch(random.Random(1), 5), BATCH).withColumn("source", F.lit("reddit")), "reddit", "s0-1", T0)
    (tmp_path / "items/log/source=reddit/run=s0-1/batch=s0-1/_SUCCESS").unlink()
    assert store.current().count() == 0
    assert not store.has_batch("reddit", "s0-1")


def test_insert_then_update(spark, tmp_path):
    store = ItemStore(spark, str(tmp_path / "items"))
    row = ("reddit", "q-17", "Yields climb again", T0, 1, "bullish", 1, ["macro"], [0.75, 0.125, 0.5], '{"n":17}', "h")
    store.append(spark.createDataFrame([row], BATCH), "reddit", "b1", T0)
    first = lookup_by_source_id(store.current(), "q-17").first()
    assert first.topics == ["macro"] and first.embedding == [0.75, 0.125, 0.5] and first.tickers is None or first.tickers == []
    changed = (*row[:4], -1, *row[5:])
    store.append(spark.createDataFrame([changed], BATCH), "reddit", "b2", T0 + timedelta(days=1))
    second = lookup_by_source_id(store.current(), "q-17").first()
    assert second.sentiment == -1 and second.id == first.id and second.created_at == first.created_at
    assert second.updated_at > first.updated_at
    assert lookup_by_source_id(store.current(), "nope").count() == 0


def test_lookup_reaches_the_scan(spark, tmp_path):
    store = ItemStore(spark, str(tmp_path / "items"))
    store.append(spark.createDataFrame(batch(random.Random(1), 20), BATCH), "reddit", "b1", T0)
    store.compact()
    plan = lookup_by_source_id(store.current(), "k1")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(source_id,k1)" in plan


def test_only_touched_sources_are_rewritten(spark, tmp_path):
    store = ItemStore(spark, str(tmp_path / "items"))
    rng = random.Random(2)
    rows = batch(rng, 30)
    for source in ("reddit", "twitter"):
        store.append(spark.createDataFrame([r for r in rows if r[0] == source], BATCH), source, "b1", T0)
    assert store.compact() == 0
    first = store.live_paths()
    store.append(spark.createDataFrame([(*rows[0][:2], "new", *rows[0][3:])], BATCH), rows[0][0], "b2", T0 + timedelta(days=1))
    assert store.compact() == 1
    second = store.live_paths()
    assert [s for s in first if first[s] != second[s]] == [rows[0][0]]
    before = seen(store.current())
    store.forget(keep_versions=1)
    assert seen(store.current()) == before
    declare_items(spark, "items_live", store)
    assert seen(spark.table("items_live")) == before and len(before) > 5
    spark.sql("DROP TABLE items_live")


def test_two_compactions_do_not_write_one_version(spark, tmp_path):
    store = ItemStore(spark, str(tmp_path / "items"))
    store.append(spark.createDataFrame(batch(random.Random(1), 5), BATCH), "reddit", "b1", T0)
    (tmp_path / "items/folded").mkdir()
    (tmp_path / "items/folded/_writing-v=00000000").touch()
    with pytest.raises(RuntimeError):
        store.compact()
    (tmp_path / "items/folded/_writing-v=00000000").unlink()
    assert store.compact() == 0


def test_upsert_reads_each_side_once(spark):
    rows = spark.createDataFrame(batch(random.Random(1), 8), BATCH)
    fields = [c for c in PAYLOAD if c in BATCH]
    current = merge.upsert(None, rows, F.lit(T0), merge.KEY, fields, ("content_hash",))
    merged = merge.upsert(current, rows, F.lit(T0), merge.KEY, fields, ("content_hash",))
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") + plan.count("LocalTableScan") == 2 and plan.count("Join") == 1


def test_create_table(spark, tmp_path):
    create_items_table(spark, "items_declared", str(tmp_path / "t"))
    fields = {f.name: f.dataType for f in spark.table("items_declared").schema.fields}
    assert fields == {f.name: f.dataType for f in ITEMS.fields}
    parts = [c.name for c in spark.catalog.listColumns("items_declared") if c.isPartition]
    spark.sql("DROP TABLE items_declared")
    assert parts == ["source"]


# ---- stored vectors --------------------------------------------------------------------

MANY = "content_hash string, embedding array<float>, written_at timestamp"


def hashes(spark, first, n, at="2024-01-01 00:00:00"):
    rows = spark.range(first, first + n).select(F.sha2(F.col("id").cast("string"), 256).alias("content_hash"), "id")
    return rows.select("content_hash", F.array(F.col("id").cast("float")).alias("embedding"), F.lit(at).cast("timestamp").alias("written_at"))


def test_a_batch_meets_stored_vectors_where_they_lie(spark, tmp_path):
    cache = VectorCache(spark, str(tmp_path / "vectors"), buckets=6)
    assert cache.read("reddit").count() == 0
    cache.write(hashes(spark, 0, 150_000), "reddit", "a")
    cache.write(hashes(spark, 100_000, 60_000, "2024-01-02 00:00:00"), "reddit", "b")
    items = hashes(spark, 120_000, 100_000).select("content_hash", F.lit("x").alias("text"))
    items.write.parquet(str(tmp_path / "items"))
    items = spark.read.parquet(str(tmp_path / "items"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = attach_cached(items, cache.for_hashes(items, "reddit"))
        got = joined.agg(F.count("*").alias("n"), F.count("cached_embedding").alias("hits"), F.sum(F.col("cached_embedding")[0].cast("double")).alias("s")).first()
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert (got.n, got.hits, got.s) == (100_000, 40_000, sum(range(120_000, 160_000)))
    # Exchanges lie over the items only; the cache is read bucket by bucket.
    assert plan.count("Exchange") > 0 and "Bucketed: true" in plan
    for part in plan.split("Exchange")[1:]:
        scan = next(line for line in part.splitlines() if "FileScan" in line)
        assert "tmp" in scan and "/items" in scan, scan
    # A replay replaces its batch; another session declares the table anew; compaction keeps the newest.
    cache.write(hashes(spark, 100_000, 5, "2024-01-03 00:00:00"), "reddit", "b")
    assert cache.read("reddit").count() == 150_005 and cache.read("reddit", without="b").count() == 150_000
    spark.sql(f"DROP TABLE {cache.table('reddit')}")
    assert VectorCache(spark, str(tmp_path / "vectors"), buckets=6).read("reddit").count() == 150_005
    cache.compact("reddit", "all")
    assert cache.read("reddit").count() == 150_000
    assert cache.read("reddit").filter("written_at = timestamp '2024-01-03 00:00:00'").count() == 5
    assert [p.name for p in (tmp_path / "vectors/buckets=6/source=reddit").glob("batch=*")] == ["batch=all"]
