"""Upsert by key, the last version winning."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.schemas import LABELS

# Default key. ``("source_id",)`` treats equal ids of two sources as one item.
KEY = ("source", "source_id")


def item_id(key: Sequence[str]) -> Column:
    """UUID-shaped id that depends on the key only."""
    digest = F.md5(F.concat_ws("\x1f", *key))
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat_ws("-", *[F.substring(digest, start, length) for start, length in cuts])


def fingerprint(columns: Sequence[str]) -> Column:
    """64-bit hash of a row's values; NULLs and array sizes count as well."""
    nulls = F.concat(*[F.col(c).isNull().cast("int").cast("string") for c in columns])
    return F.xxhash64(nulls, *columns)


def reduce_batch(
    batch: DataFrame, key: Sequence[str], payload: Sequence[str], order: Sequence[str], keep: Sequence[str] = ()
) -> DataFrame:
    """One row per key of a batch: its last version by ``order``.

    ``flips`` tells whether the batch holds differing versions of the key, and
    ``labelled`` is its last set of labels that is not missing (only with
    ``keep``). All of it is one aggregate that combines on the map side.
    """
    order_by = F.struct(*order)
    fields = [c for c in payload if c not in key]
    # With ``keep``, missing labels do not count as a change.
    prints = {"_print": fingerprint([c for c in fields if c not in keep])}
    aggregates = [F.max_by(F.struct(*fields), order_by).alias("_row")]
    if keep:
        known = F.when(F.col(keep[-1]).isNotNull(), F.struct(*keep))
        aggregates.append(F.max_by(known, F.when(known.isNotNull(), order_by)).alias("labelled"))
        prints["_label_print"] = F.when(known.isNotNull(), fingerprint(keep))
    differ = [F.coalesce(F.min(c) != F.max(c), F.lit(False)) for c in prints]
    aggregates.append(reduce(or_, differ).alias("flips"))
    reduced = batch.withColumns(prints).groupBy(*key).agg(*aggregates)
    return reduced.select(*key, "_row.*", "flips", *(["labelled"] if keep else []))


def merge_versions(
    current: DataFrame | None,
    batches: DataFrame,
    key: Sequence[str] = KEY,
    payload: Sequence[str] = (),
    keep_existing_on_null: bool = False,
) -> DataFrame:
    """Apply reduced batches to the current table (None: there is none yet).

    ``current`` has one row per key with ``created_at`` and ``updated_at``.
    ``batches`` has one row per key and batch with ``batch_time``, ``batch_key`` and
    ``flips`` (see ``reduce_batch``); it is read twice, so give a written table. A
    key is created with its first batch; ``updated_at`` is the time of the last
    batch that changed any payload field. Rows of ``current`` that no batch touches
    are passed on without being shuffled when the touched keys are few (Spark
    measures them and broadcasts below its threshold).

    The window runs over one key: at most one row per waiting batch.
    """
    fields = [c for c in payload if c not in key]
    labels = [c for c in LABELS if c in fields]
    if keep_existing_on_null and not labels:
        raise ValueError("keep_existing_on_null needs label columns in the payload")

    versions = batches.withColumn("_later", F.lit(True))
    if current is not None:
        touched_keys = batches.select(*key).distinct()
        base = current.join(touched_keys, list(key), "left_semi").withColumns(
            {
                "batch_time": F.col("created_at"),
                "batch_key": F.lit(""),
                "flips": F.lit(False),
                "_later": F.lit(False),
            }
        )
        if keep_existing_on_null:
            known = F.when(F.col(labels[-1]).isNotNull(), F.struct(*labels))
            base = base.withColumn("labelled", known)
        versions = base.unionByName(versions, allowMissingColumns=True)
    else:
        stamps = {c: F.lit(None).cast("timestamp") for c in ("created_at", "updated_at")}
        versions = versions.withColumns(stamps)

    w = Window.partitionBy(*key).orderBy("_later", "batch_time", "batch_key")
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if keep_existing_on_null:
        carried = F.last("labelled", ignorenulls=True).over(so_far)
        versions = versions.withColumn("_labels", carried).withColumns(
            {c: F.when(F.col("_labels").isNotNull(), F.col(f"_labels.{c}")).otherwise(F.col(c)) for c in labels}
        ).drop("_labels", "labelled")

    versions = versions.withColumn("_row", F.struct(*fields)).withColumns(
        {"_before": F.lag("_row").over(w), "_next": F.lead("batch_key").over(w)}
    )
    changed = F.col("_before").isNull() | ~F.col("_before").eqNullSafe(F.col("_row")) | F.col("flips")
    stamp = F.when(~F.col("_later"), F.col("updated_at")).when(changed, F.col("batch_time"))
    merged = (
        versions.withColumns({"_stamp": stamp, "_start": F.coalesce("created_at", "batch_time")})
        .withColumns(
            {
                "created_at": F.first("_start").over(so_far),
                "updated_at": F.last("_stamp", ignorenulls=True).over(so_far),
            }
        )
        .filter(F.col("_next").isNull())
    )
    if current is None:
        extra = [c for c in batches.columns if c not in ("batch_time", "batch_key", "flips", "labelled")]
        return merged.select(*extra, "created_at", "updated_at")
    untouched = current.join(touched_keys, list(key), "left_anti")
    return untouched.unionByName(merged.select(*current.columns))


def upsert(
    current: DataFrame | None,
    batch: DataFrame,
    batch_time: Column,
    key: Sequence[str] = KEY,
    payload: Sequence[str] = (),
    order: Sequence[str] = ("seq",),
    keep_existing_on_null: bool = False,
) -> DataFrame:
    """The table after one batch of rows, later rows winning.

    Each side is read once: the batch is reduced to a row per key and meets the table in one outer join.
    """
    labels = [c for c in LABELS if c in payload] if keep_existing_on_null else []
    reduced = reduce_batch(batch, key, payload, order, labels)
    if current is None or "id" in current.columns:
        reduced = reduced.withColumn("id", item_id(key))
    if current is None:
        # One batch into an empty table: its reduced rows are the table.
        if keep_existing_on_null:
            kept = {c: F.coalesce(F.col(f"labelled.{c}"), F.col(c)) for c in labels}
            reduced = reduced.withColumns(kept).drop("labelled")
        return reduced.drop("flips").withColumns({"created_at": batch_time, "updated_at": batch_time})
    fields = [c for c in payload if c not in key]
    old, new = current.alias("old"), reduced.withColumn("_new", F.lit(True)).alias("new")
    same_key = reduce(and_, [F.col(f"old.{c}").eqNullSafe(F.col(f"new.{c}")) for c in key])
    both = old.join(new, same_key, "full_outer")
    fresh = F.coalesce(F.col("new._new"), F.lit(False))
    values = {c: F.col(f"new.{c}") for c in fields}
    if labels:
        # The batch's last known labels, else the stored ones if they are known, else none.
        stored = F.col(f"old.{labels[-1]}").isNotNull()
        values |= {
            c: F.when(F.col("new.labelled").isNotNull(), F.col(f"new.labelled.{c}"))
            .when(stored, F.col(f"old.{c}")).otherwise(F.col(f"new.{c}"))
            for c in labels
        }
    differ = reduce(or_, [~F.col(f"old.{c}").eqNullSafe(values[c]) for c in fields]) | F.col("new.flips")
    started = F.col("old.created_at")
    stamps = {
        "created_at": F.when(started.isNull(), batch_time).otherwise(started),
        "updated_at": F.when(fresh & (started.isNull() | differ), batch_time).otherwise(F.col("old.updated_at")),
    }
    out = []
    for c in current.columns:
        if c in stamps:
            out.append(stamps[c].alias(c))
        elif c in key or c == "id":
            out.append(F.coalesce(f"old.{c}", f"new.{c}").alias(c))
        elif c in values:
            out.append(F.when(fresh, values[c]).otherwise(F.col(f"old.{c}")).alias(c))
        else:
            out.append(F.col(f"old.{c}").alias(c))
    return both.select(*out)
