"""The item table on Parquet: an append log of batches and compacted versions.

    <root>/log/source=<s>/run=<r>/batch=<key>   enriched rows of one batch, as ingested
    <root>/base/v=<n>/source=<s>                one row per key, in the version that last wrote the source
    <root>/folded/v=<n>                         manifest of version n and its commit: the version that holds
                                                each source, and the folded batches that still are in the log

Plain Parquet has no MERGE, so a batch is appended and the current table is the
last base plus the batches after it. Writers of different sources never touch the
same folder. Every write is one Spark job, so a batch is stored as a whole or not at all, and a
replayed batch replaces itself.

All batches of a run count as one: of equal texts of a source the newest is kept, of the versions of a key the one
published last, whatever the cut into batches. Between runs the later run wins. A version folds whole runs only, and
rewrites only the sources that have waiting batches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom.functions.times import utc
from feedloom.operators.dedup import keep_first
from feedloom.operators.merge import KEY, item_id, merge_versions, reduce_batch
from feedloom.schemas import ITEMS, LABELS, NORMALIZED, PAYLOAD
from feedloom.sources.files import claimed, committed, listed, make_folder, remove, remove_all_but_newest

LOG = T.StructType(
    [T.StructField(c, ITEMS[c].dataType) for c in PAYLOAD if c != "source"]
    + [
        T.StructField("content_hash", T.StringType()),
        T.StructField("embedding_reused", T.BooleanType()),
        T.StructField("classification_error", T.StringType()),
        T.StructField("embedding_error", T.StringType()),
        T.StructField("batch_time", T.TimestampType()),
    ]
)
# Order of a batch's versions of one key: a later post wins; the hash settles ties.
BATCH_ORDER = ("published_at", "content_hash")


class ItemStore:
    def __init__(
        self,
        spark: SparkSession,
        root: str,
        key: Sequence[str] = KEY,
        keep_existing_on_null: bool = False,
    ) -> None:
        self.spark = spark
        self.root = root.rstrip("/")
        self.key = tuple(key)
        self.keep_existing_on_null = keep_existing_on_null

    # ---- log -----------------------------------------------------------------

    def log_path(self, source: str, batch_key: str, run: str | None = None) -> str:
        return f"{self.root}/log/source={source}/run={run or batch_key}/batch={batch_key}"

    def _stored(self, source: str, batch_key: str) -> list[str]:
        return committed(self.spark, f"{self.root}/log/source={source}/run=*/batch={batch_key}")

    def has_batch(self, source: str, batch_key: str) -> bool:
        return bool(self._stored(source, batch_key))

    def append(
        self, rows: DataFrame, source: str, batch_key: str, batch_time: datetime, run: str | None = None
    ) -> None:
        """Write one batch of enriched rows of ``source`` as a whole; without a run it is one of its own."""
        stamped = rows.withColumn("batch_time", F.lit(utc(batch_time)))
        missing = {f.name: F.lit(None).cast(f.dataType) for f in LOG.fields if f.name not in stamped.columns}
        stamped.withColumns(missing).select(*LOG.fieldNames()).write.mode("overwrite").parquet(
            self.log_path(source, batch_key, run)
        )

    def read_batch(self, source: str, batch_key: str) -> DataFrame:
        rows = self.spark.read.schema(LOG).parquet(self._stored(source, batch_key)[0])
        return rows.withColumn("source", F.lit(source))

    def _read_log(self, paths: Sequence[str]) -> DataFrame:
        parts = [T.StructField(c, T.StringType()) for c in ("source", "run", "batch")]
        schema = T.StructType(LOG.fields + parts)
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/log").parquet(*paths)

    # ---- versions ------------------------------------------------------------

    def version(self) -> int:
        done = committed(self.spark, f"{self.root}/folded/v=*")
        return int(done[-1].rsplit("=", 1)[1]) if done else -1

    def _manifest(self, version: int) -> tuple[dict[str, int], set[str]]:
        """(version that holds each source, folded batches still in the log): a row per source and such batch."""
        if version < 0:
            return {}, set()
        rows = self.spark.read.parquet(f"{self.root}/folded/v={version:08d}").collect()
        return {r.name: r.version for r in rows if r.kind == "live"}, {r.name for r in rows if r.kind == "folded"}

    def base_path(self, source: str, version: int) -> str:
        return f"{self.root}/base/v={version:08d}/source={source}"

    def live_paths(self) -> dict[str, str]:
        """The folder of each source in the current version."""
        return {s: self.base_path(s, v) for s, v in self._manifest(self.version())[0].items()}

    def base(self, version: int | None = None, sources: Sequence[str] | None = None) -> DataFrame:
        live, _ = self._manifest(self.version() if version is None else version)
        stored = T.StructType([f for f in ITEMS.fields if f.name != "source"])
        parts = [
            self.spark.read.schema(stored).parquet(self.base_path(s, v)).withColumn("source", F.lit(s)).select(*ITEMS.fieldNames())
            for s, v in sorted(live.items())
            if sources is None or s in sources
        ]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], ITEMS)

    def _waiting(self, version: int, open_runs: Sequence[str] = ()) -> list[str]:
        """Committed batches that are not part of ``version``, without those of open runs."""
        _, folded = self._manifest(version)
        paths = committed(self.spark, f"{self.root}/log/source=*/run=*/batch=*")
        return [p for p in paths if self._name(p) not in folded and self._part(p, "run") not in open_runs]

    @staticmethod
    def _part(path: str, name: str) -> str:
        return next(x.split("=", 1)[1] for x in path.split("/") if x.startswith(f"{name}="))

    @staticmethod
    def _name(path: str) -> str:
        return "/".join(path.rstrip("/").split("/")[-3:])

    def _merged(self, version: int, paths: Sequence[str], sources: Sequence[str] | None = None) -> DataFrame:
        labels = LABELS if self.keep_existing_on_null else ()
        log = self._read_log(paths)
        # A run's batches have one time, so that stamps do not depend on the cut into batches either.
        starts = log.groupBy("run").agg(F.min("batch_time").alias("batch_time"))
        text = F.coalesce("content_hash", F.concat_ws("/", "batch", "source_id"))
        once = keep_first(
            log.withColumn("_text", F.struct("source", "run", text)),
            [F.col("published_at").desc(), F.col("source_id"), F.col("content_hash").desc()],
            "_text",
        ).drop("_text")
        reduced = reduce_batch(once, [*self.key, "run"], PAYLOAD, BATCH_ORDER, labels).withColumnRenamed("run", "batch_key")
        reduced = reduced.join(F.broadcast(starts.withColumnRenamed("run", "batch_key")), "batch_key")
        reduced = reduced.withColumn("id", item_id(self.key))
        base = self.base(version, sources) if version >= 0 else None
        merged = merge_versions(base, reduced, self.key, PAYLOAD, self.keep_existing_on_null)
        return merged.select(*ITEMS.fieldNames())

    def current(self) -> DataFrame:
        """The item table now: one row per key."""
        version = self.version()
        waiting = self._waiting(version)
        return self._merged(version, waiting) if waiting else self.base(version)

    def compact(self, open_runs: Sequence[str] = ()) -> int:
        """Fold the waiting batches of finished runs into a new version and return its number.

        Only sources with such batches are written (all of them, if keys cross sources). Rows are laid out by
        source and day and sorted by time, so row-group statistics serve both filters. The rebalance lets Spark split a
        large day of a large source over several files and join small ones, without the extra pass a
        range partitioning would sample. A Bloom filter per row group serves look-ups by source_id.
        """
        version = self.version()
        waiting = self._waiting(version, open_runs)
        if not waiting:
            return version
        new = version + 1
        live, folded = self._manifest(version)
        touched = {self._part(p, "source") for p in waiting}
        if "source" not in self.key:
            touched |= set(live)
        with claimed(self.spark, f"{self.root}/folded/_writing-v={new:08d}"):
            (
                self._merged(version, waiting, sorted(touched))
                .withColumn("_day", F.date_trunc("day", "published_at"))
                .hint("rebalance", "source", "_day")
                .sortWithinPartitions("source", "published_at")
                .drop("_day")
                .write.mode("overwrite")
                .partitionBy("source")
                .option("parquet.bloom.filter.enabled#source_id", "true")
                .parquet(f"{self.root}/base/v={new:08d}")
            )
            written = {self._part(p, "source") for p in listed(self.spark, f"{self.root}/base/v={new:08d}/source=*")}
            live = {s: v for s, v in live.items() if s not in touched} | {s: new for s in written}
            there = {self._name(p) for p in committed(self.spark, f"{self.root}/log/source=*/run=*/batch=*")}
            names = (folded & there) | {self._name(p) for p in waiting}
            rows = [("live", s, v) for s, v in live.items()] + [("folded", n, new) for n in names]
            manifest = self.spark.createDataFrame(rows, "kind string, name string, version int").coalesce(1)
            manifest.write.mode("overwrite").parquet(f"{self.root}/folded/v={new:08d}")
        return new

    def forget(self, open_runs: Sequence[str] = (), keep_versions: int = 2) -> None:
        """Delete folded batches and versions that nobody needs.

        The last batch of a source stays, since a stream may replay it. The last ``keep_versions`` manifests
        and what they refer to stay for running readers.
        """
        version = self.version()
        _, folded = self._manifest(version)
        by_source: dict[str, list[str]] = {}
        for path in committed(self.spark, f"{self.root}/log/source=*/run=*/batch=*"):
            by_source.setdefault(self._part(path, "source"), []).append(path)
        for paths in by_source.values():
            last = max(paths, key=lambda p: (self._part(p, "run"), self._part(p, "batch")))
            remove(self.spark, [p for p in paths if p != last and self._name(p) in folded and self._part(p, "run") not in open_runs])
        kept = [v for v in range(max(0, version - keep_versions + 1), version + 1)]
        needed = {self.base_path(s, v) for n in kept for s, v in self._manifest(n)[0].items()}
        needed = {"/".join(p.split("/")[-2:]) for p in needed}
        paths = listed(self.spark, f"{self.root}/base/v=*/source=*")
        remove(self.spark, [p for p in paths if "/".join(p.split("/")[-2:]) not in needed and int(self._part(p, "v")) <= version])
        old = committed(self.spark, f"{self.root}/folded/v=*")
        remove(self.spark, [p for p in old if int(self._part(p, "v")) not in kept])


def lookup_by_source_id(items: DataFrame, source_id: str) -> DataFrame:
    return items.filter(F.col("source_id") == source_id)


def create_items_table(spark: SparkSession, name: str, location: str) -> None:
    """Declare the item table, partitioned by source."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ITEMS.fields)
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet "
        f"PARTITIONED BY (source) LOCATION '{location}'"
    )


def declare_items(spark: SparkSession, name: str, store: ItemStore) -> None:
    """Point a declared table at the current version of a store; call it again after a compaction."""
    create_items_table(spark, name, f"{store.root}/base")
    for row in spark.sql(f"SHOW PARTITIONS {name}").collect():
        source = row[0].split("=", 1)[1]
        spark.sql(f"ALTER TABLE {name} DROP IF EXISTS PARTITION (source = '{source}')")
    for source, path in store.live_paths().items():
        spark.sql(f"ALTER TABLE {name} ADD PARTITION (source = '{source}') LOCATION '{path}'")


class BatchTable:
    """A small append-only side table with the same commit rule: <root>/source=<s>/batch=<key>."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType) -> None:
        self.spark = spark
        self.root = root.rstrip("/")
        self.schema = schema

    def path(self, source: str, batch_key: str) -> str:
        return f"{self.root}/source={source}/batch={batch_key}"

    def write(self, rows: DataFrame, source: str, batch_key: str) -> None:
        rows.select(*self.schema.fieldNames()).write.mode("overwrite").parquet(self.path(source, batch_key))

    def read(self, source: str, without: str | None = None) -> DataFrame:
        """Committed rows of a source, leaving out one batch (the one being replayed)."""
        paths = [p for p in committed(self.spark, self.path(source, "*")) if not p.endswith(f"/batch={without}")]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def read_with_batch(self, source: str) -> DataFrame:
        """Committed rows of a source with the key of their batch."""
        schema = T.StructType([*self.schema.fields, T.StructField("batch", T.StringType())])
        paths = committed(self.spark, self.path(source, "*"))
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/source={source}").parquet(*paths)

    def has(self, source: str, batch_key: str) -> bool:
        return bool(committed(self.spark, self.path(source, batch_key)))

    def read_batch(self, source: str, batch_key: str) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path(source, batch_key))

    def clear(self, source: str, keep: str | None = None) -> None:
        """Delete the batches of a source, all but one."""
        remove(self.spark, [p for p in committed(self.spark, self.path(source, "*")) if not p.endswith(f"/batch={keep}")])

    def forget_old(self, source: str, keep: int) -> None:
        remove_all_but_newest(self.spark, self.path(source, "*"), keep)


class VectorCache:
    """Stored vectors by content hash, a bucketed table for each source: <root>/buckets=<n>/source=<s>/batch=<key>.

    Rows lie in ``buckets`` sorted by their hash, so a batch is dealt into as many parts by its own hashes and meets the
    vectors where they lie: the history is never shuffled. A batch is one partition and replaces itself when it is
    replayed. The table is declared in the session's catalog at first use; the folder is all that lasts. The number of
    buckets is part of the path, as vectors of another number would not meet.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64) -> None:
        self.spark = spark
        self.root = root.rstrip("/")
        self.buckets = buckets

    def path(self, source: str) -> str:
        return f"{self.root}/buckets={self.buckets}/source={source}"

    def table(self, source: str) -> str:
        """The name of a source's table, which is declared if this session does not know it."""
        name = f"feedloom_vectors_{hashlib.md5(self.path(source).encode()).hexdigest()}"
        if not self.spark.catalog.tableExists(name):
            make_folder(self.spark, self.path(source))
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in VECTORS.fields)
            self.spark.sql(
                f"CREATE TABLE IF NOT EXISTS {name} ({columns}, batch string) USING parquet PARTITIONED BY (batch) "
                f"CLUSTERED BY (content_hash) SORTED BY (content_hash) INTO {self.buckets} BUCKETS LOCATION '{self.path(source)}'"
            )
            self.spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")
        return name

    def write(self, rows: DataFrame, source: str, batch_key: str, how: str = "OVERWRITE") -> None:
        name = self.table(source)
        # One file for each bucket: a task has one bucket.
        laid = rows.select(*VECTORS.fieldNames()).repartition(self.buckets, "content_hash")
        session = rows.sparkSession
        view = f"{name}_new"
        laid.createOrReplaceTempView(view)
        session.sql(f"INSERT {how} TABLE {name} PARTITION (batch = '{batch_key}') SELECT * FROM {view}")
        session.catalog.dropTempView(view)

    def read(self, source: str, without: str | None = None) -> DataFrame:
        """All stored vectors of a source, leaving out one batch (the one being replayed)."""
        rows = self.spark.table(self.table(source))
        return rows if without is None else rows.filter(F.col("batch") != without)

    def for_hashes(self, items: DataFrame, source: str, without: str | None = None, written_after: datetime | None = None) -> DataFrame:
        """The stored vectors of a source that items (content_hash) may be joined with."""
        rows = self.read(source, without)
        if written_after is not None:
            rows = rows.filter(F.col("written_at") >= F.lit(utc(written_after)))
        return rows.select(*VECTORS.fieldNames())

    def compact(self, source: str, batch_key: str) -> None:
        """Put all vectors of a source into one batch, the one written last per hash; buckets are folded where they lie.

        Until the old folders are gone, readers see both, which does no harm. Do not run it beside the
        query of the same source.
        """
        name = self.table(source)
        old = [r[0].split("=", 1)[1] for r in self.spark.sql(f"SHOW PARTITIONS {name}").collect()]
        newest = self.read(source).groupBy("content_hash").agg(
            F.max_by("embedding", "written_at").alias("embedding"), F.max("written_at").alias("written_at")
        )
        self.write(newest, source, batch_key, "INTO")
        for batch in old:
            if batch != batch_key:
                self.spark.sql(f"ALTER TABLE {name} DROP IF EXISTS PARTITION (batch = '{batch}')")
        remove(self.spark, [f"{self.path(source)}/batch={b}" for b in old if b != batch_key])


VECTORS = T.StructType(
    [
        T.StructField("content_hash", T.StringType()),
        T.StructField("embedding", ITEMS["embedding"].dataType),
        T.StructField("written_at", T.TimestampType()),
    ]
)
PREPARED = T.StructType(NORMALIZED.fields + [T.StructField("content_hash", T.StringType())])
MARKS = T.StructType([T.StructField("mark", T.TimestampType()), T.StructField("written_at", T.TimestampType())])
REJECTS = T.StructType([T.StructField("line", T.StringType()), T.StructField("violations", T.ArrayType(T.StringType()))])
LATE = T.StructType(
    [
        T.StructField(c, NORMALIZED[c].dataType)
        for c in ("source", "source_id", "author", "published_at")
    ]
    + [T.StructField("raw", T.StringType()), T.StructField("bound", T.TimestampType())]
)
RUNS = T.StructType(
    [
        T.StructField("run", T.StringType()),
        T.StructField("bound", T.TimestampType()),
        T.StructField("closed", T.BooleanType()),
        T.StructField("written_at", T.TimestampType()),
    ]
)
IDENTITIES = T.StructType([T.StructField("identity", T.StringType())])
COUNTS = T.StructType([T.StructField(c, T.LongType()) for c in ("stored", "reused", "failed", "late", "rejected", "latest")])
