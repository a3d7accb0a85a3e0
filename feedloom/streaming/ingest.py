"""Streaming ingest: one query per source, each batch stored as a whole.

Order of writes in a micro-batch: identity, rejects, late rows, prepared items, enriched rows, new
vectors, mark. Each is one committed folder named by the batch, so a batch that is replayed
after a failure finds what was written and the model is not asked again.

Lateness is judged against the bound of the source's run and not against the mark of the last batch: the
bound is the resume point when a run starts, and moves only when a run has worked off its backlog. So the result
does not depend on how a backlog is cut into batches or in which order files land. Rows under the bound go to
the ``late`` table. A poll is one run, and an unfinished run that restarts keeps its bound; a batch never joins a
finished run, which may be folded already. The store treats all batches of a run as one (see ``ItemStore``).

What a batch kept, set aside, reused and failed on is counted by the jobs that write it (``observe``) and read without a
second pass.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from feedloom.functions.times import default_since, utc
from feedloom.operators.constraints import split_valid
from feedloom.operators.dedup import mark_hash
from feedloom.operators.inference import EmbeddingProvider, HashingEmbedder
from feedloom.plans.enrich import Classifier, enrich, prepare, with_lexicon
from feedloom.schemas import JobSettings
from feedloom.operators.ranking import newest_per_feed
from feedloom.sources.feeds import (
    CHECKED,
    FEEDS,
    Feed,
    clean_items,
    matching,
    parse_lines,
    since_split,
    split_bad_lines,
    stream_lines,
)
from feedloom.sources.store import COUNTS, IDENTITIES, LATE, MARKS, PREPARED, REJECTS, RUNS, BatchTable, ItemStore, VectorCache

logger = logging.getLogger(__name__)


# Run records kept per source; only the last one is read.
KEPT_RUNS = 10

OBSERVED = ("stored", "reused", "failed", "latest", "late", "rejected")


def _stored_counts() -> dict[str, Column]:
    failed = F.col("classification_error").isNotNull() | F.col("embedding_error").isNotNull()
    return {
        "stored": F.count("*"), "reused": F.count_if(F.col("embedding_reused")), "failed": F.count_if(failed),
        "latest": F.unix_micros(F.max("published_at")),
    }


@dataclass(frozen=True)
class Run:
    """A stretch of work on a source; rows at or under its bound are late."""

    name: str
    bound: datetime
    closed: bool


def utc_now() -> datetime:
    return datetime.now(tz=timezone.utc)


@dataclass
class IngestJob:
    """Everything the sources of one store share."""

    spark: SparkSession
    root: str
    classifier: Classifier = with_lexicon
    embedder: Callable[[], EmbeddingProvider] = HashingEmbedder
    settings: JobSettings = field(default_factory=JobSettings)
    keywords: Sequence[str] | None = None
    newest: int | None = None
    # How far back stored vectors are looked up. An older text is embedded anew,
    # with the same result; the bound keeps a batch from reading the whole history.
    vector_lookback: timedelta | None = None
    # Parts that stored vectors lie in, and tasks that look them up; more for a longer history.
    vector_buckets: int = 64
    # Such as "7 days": a line that landed within that time before, in any batch, is passed over. Off by default.
    drop_relanded: str | None = None
    # Tasks that call the models. Slow models need more than the size of the texts suggests.
    model_tasks: int | None = None
    clock: Callable[[], datetime] = utc_now
    store: ItemStore | None = None
    feeds: Mapping[str, Feed] = field(default_factory=lambda: FEEDS)

    def __post_init__(self) -> None:
        self.root = self.root.rstrip("/")
        self.store = self.store or ItemStore(self.spark, f"{self.root}/items")
        self.vectors = VectorCache(self.spark, f"{self.root}/vectors", self.vector_buckets)
        self.prepared = BatchTable(self.spark, f"{self.root}/prepared", PREPARED)
        self.marks = BatchTable(self.spark, f"{self.root}/marks", MARKS)
        self.rejects = BatchTable(self.spark, f"{self.root}/rejects", REJECTS)
        self.late = BatchTable(self.spark, f"{self.root}/late", LATE)
        self.runs = BatchTable(self.spark, f"{self.root}/runs", RUNS)
        self.identities = BatchTable(self.spark, f"{self.root}/identities", IDENTITIES)
        self.counts = BatchTable(self.spark, f"{self.root}/counts", COUNTS)

    # ---- marks ---------------------------------------------------------------

    def mark(self, source: str) -> datetime | None:
        """The latest time stored for a source, never beyond the clock; one value."""
        last = self.marks.read(source).agg(F.unix_micros(F.max("mark")).alias("m")).first().m
        return None if last is None else _from_micros(last)

    def _write_mark(self, source: str, batch_key: str, mark: datetime) -> None:
        now = utc(self.clock())
        row = self.spark.range(1).select(F.lit(min(utc(mark), now)).alias("mark"), F.lit(now).alias("written_at"))
        self.marks.write(row, source, batch_key)

    # ---- runs ----------------------------------------------------------------

    def run(self, source: str) -> Run | None:
        """The last run of a source."""
        row = self.runs.read(source).select(
            F.max_by(F.struct("run", F.unix_micros("bound").alias("b"), "closed"), F.struct("written_at", "closed")).alias("r")
        ).first().r
        return None if row is None else Run(row.run, _from_micros(row.b), row.closed)

    def _write_run(self, source: str, run: Run) -> None:
        now = utc(self.clock())
        row = self.spark.range(1).select(
            F.lit(run.name).alias("run"), F.lit(run.bound).alias("bound"), F.lit(run.closed).alias("closed"), F.lit(now).alias("written_at")
        )
        self.runs.write(row, source, f"{now:%Y%m%dT%H%M%S%f}")
        self.runs.forget_old(source, KEPT_RUNS)

    def resume(self, source: str, since: datetime | None = None) -> datetime | None:
        """Open a run, or go on with an unfinished one, and return its bound; NULL for a source nobody registered.

        An explicit time wins and may go back; an unfinished run keeps its bound; else the stored mark; else
        two intervals before now.
        """
        if source not in self.feeds:
            logger.warning("unknown source %s", source)
            return None
        now, last = utc(self.clock()), self.run(source)
        if since is None and last is not None and not last.closed:
            return last.bound
        mark = self.mark(source) if last is not None else None
        bound = utc(since) if since is not None else mark or (last.bound if last else default_since(now, self.settings.fetch_interval_seconds))
        self._write_run(source, Run(f"{now:%Y%m%dT%H%M%S%f}", utc(bound), False))
        return utc(bound)

    def open_run(self, source: str) -> Run:
        """The run that a new batch belongs to; a finished one is followed by a new one."""
        last = self.run(source)
        if last is None or last.closed:
            self.resume(source)
            last = self.run(source)
        return last

    def finish_run(self, source: str) -> None:
        """The backlog is worked off: the next run starts from the mark, and the store may fold this run's batches."""
        last = self.run(source)
        if last is not None and not last.closed:
            self._write_run(source, Run(last.name, last.bound, True))

    def compact(self) -> int:
        """Fold the batches of finished runs into a new version of the store and drop what they need no more."""
        open_runs = [r.name for r in map(self.run, self.feeds) if r is not None and not r.closed]
        version = self.store.compact(open_runs)
        self.store.forget(open_runs)
        for source in self.feeds:
            if (last := self.run(source)) is not None and last.closed:
                self.prepared.clear(source)
                mark = self.mark(source)
                if mark is not None:
                    kept = self._mark_name()
                    self._write_mark(source, kept, mark)
                    self.marks.clear(source, keep=kept)
        return version

    def _mark_name(self) -> str:
        return f"all-{utc(self.clock()):%Y%m%dT%H%M%S%f}"

    # ---- one batch -----------------------------------------------------------

    def process(self, lines: DataFrame, source: str, batch_key: str) -> None:
        """Store one batch of landed lines of a source."""
        feed = self.feeds[source]
        self._check_identity(lines, source, batch_key)
        seen: dict[str, int | None] = {}
        if not self.store.has_batch(source, batch_key):
            seen = self._store_batch(lines, feed, batch_key)
        rows = self.store.read_batch(source, batch_key)
        new = rows.filter(F.col("embedding").isNotNull() & ~F.col("embedding_reused"))
        self.vectors.write(new.withColumn("written_at", F.col("batch_time")), source, batch_key)
        if not self.counts.has(source, batch_key) or "stored" in seen:
            # A replay has no observed values for what an earlier attempt wrote: only then the tables are read.
            seen = self._counted_again(source, batch_key, rows) | seen if len(seen) < len(OBSERVED) else seen
            self.counts.write(self.spark.range(1).select(*[F.lit(seen[c]).cast("long").alias(c) for c in COUNTS.fieldNames()]), source, batch_key)
        else:
            seen = self.counts.read_batch(source, batch_key).first().asDict()
        if seen["latest"] is not None:
            self._write_mark(source, batch_key, _from_micros(seen["latest"]))

    def _counted_again(self, source: str, batch_key: str, rows: DataFrame) -> dict[str, int | None]:
        tables = {"rejected": self.rejects, "late": self.late}
        counts = {name: t.read_batch(source, batch_key).count() for name, t in tables.items()}
        return counts | rows.agg(*[c.alias(n) for n, c in _stored_counts().items()]).first().asDict()

    def batch_metrics(self, source: str) -> DataFrame:
        """(batch, stored, reused, failed, late, rejected, latest) of every batch of a source."""
        return self.counts.read_with_batch(source)

    def _check_identity(self, lines: DataFrame, source: str, batch_key: str) -> None:
        """Refuse a batch key that was used for other lines (a new checkpoint with an old ``stream_id``)."""
        value = F.xxhash64("value")
        now = lines.agg(
            F.count("*").alias("lines"), F.coalesce(F.bit_xor(value), F.lit(0)).alias("x"), F.coalesce(F.sum(value % 1_000_003), F.lit(0)).alias("s")
        ).first()
        identity = f"{now.lines}-{now.x & (2**64 - 1):016x}-{now.s}"
        if self.identities.has(source, batch_key):
            known = self.identities.read_batch(source, batch_key).first().identity
            if known != identity:
                raise ValueError(
                    f"batch {batch_key} of {source} was stored with other lines; a new checkpoint needs a new stream_id"
                )
        elif not self.store.has_batch(source, batch_key):
            self.identities.write(self.spark.range(1).select(F.lit(identity).alias("identity")), source, batch_key)

    def _store_batch(self, lines: DataFrame, feed: Feed, batch_key: str) -> dict[str, int | None]:
        source, seen = feed.source, {}
        run = self.open_run(source)
        now = self.clock()
        if not self.prepared.has(source, batch_key):
            seen = self._prepare_batch(lines, feed, batch_key, run)
        unique = self.prepared.read_batch(source, batch_key)
        if self.model_tasks is not None:
            unique = unique.repartition(self.model_tasks)
        after = None if self.vector_lookback is None else utc(now) - self.vector_lookback
        cache = self.vectors.for_hashes(unique, source, without=batch_key, written_after=after)
        enriched = enrich(unique, cache, self.classifier, self.embedder)
        counted = Observation()
        self.store.append(enriched.observe(counted, *[c.alias(n) for n, c in _stored_counts().items()]), source, batch_key, now, run.name)
        return seen | counted.get

    def _prepare_batch(self, lines: DataFrame, feed: Feed, batch_key: str, run: Run) -> dict[str, int | None]:
        source = feed.source
        records, bad = split_bad_lines(parse_lines(lines, feed))
        rows = matching(records, feed, self.keywords if feed.includes_since else None)
        cap = self.newest is not None and feed.capped
        if cap and feed.caps_before_since:
            rows = newest_per_feed(rows, ["source", "feed"], self.newest)
        rows, late = since_split(rows, run.bound, feed.includes_since)
        if cap and not feed.caps_before_since:
            rows = newest_per_feed(rows, ["source", "feed"], self.newest)
        late_rows, rejected_rows = Observation(), Observation()
        self.late.write(late.withColumn("bound", F.lit(run.bound)).observe(late_rows, F.count("*").alias("late")), source, batch_key)
        items = clean_items(rows, self.settings.max_text_tokens)
        valid, invalid = split_valid(items, tuple(self.feeds), CHECKED)
        rejected = bad.withColumn("violations", F.array(F.lit("malformed line"))).unionByName(
            invalid.select(F.col("raw").alias("line"), "violations")
        )
        self.rejects.write(rejected.observe(rejected_rows, F.count("*").alias("rejected")), source, batch_key)
        self.prepared.write(prepare(valid.drop("feed", "given_lang")), source, batch_key)
        return late_rows.get | rejected_rows.get

    # ---- failed model calls ----------------------------------------------------

    def ask_again(self, source: str) -> int:
        """Ask the models again for stored items of a source that have a text but no labels or no vector.

        The answers are a batch and a run of their own; call it between two polls. Returns the number of items.
        """
        last = self.run(source)
        if last is not None and not last.closed:
            raise ValueError(f"the run of {source} is not finished")
        items = self.store.current().filter((F.col("source") == source) & (F.length("text") > 0))
        items = items.filter(F.col("embedding").isNull() | F.col("sentiment").isNull())
        batch_key = f"again-{utc(self.clock()):%Y%m%dT%H%M%S%f}"
        # Written first: what is asked does not change while it is read twice.
        self.prepared.write(mark_hash(items), source, batch_key)
        rows = self.prepared.read_batch(source, batch_key)
        cache = self.vectors.for_hashes(rows, source)
        run = self.open_run(source)
        counted = Observation()
        enriched = enrich(rows, cache, self.classifier, self.embedder).observe(counted, F.count("*").alias("n"))
        self.store.append(enriched, source, batch_key, self.clock(), run.name)
        stored = self.store.read_batch(source, batch_key)
        new = stored.filter(F.col("embedding").isNotNull() & ~F.col("embedding_reused"))
        self.vectors.write(new.withColumn("written_at", F.col("batch_time")), source, batch_key)
        self.finish_run(source)
        return counted.get["n"]

    def late_counts(self, source: str) -> DataFrame:
        """How many rows of a source were set aside as late, per bound."""
        return self.late.read(source).groupBy("source", "bound").agg(F.count("*").alias("n_late"))

    def compact_vectors(self, source: str) -> None:
        """One vector per hash of a source, in one batch."""
        self.vectors.compact(source, f"all-{utc(self.clock()):%Y%m%dT%H%M%S%f}")

    # ---- queries -------------------------------------------------------------

    def start(
        self,
        source: str,
        landing: str,
        since: datetime | None = None,
        stream_id: str = "s0",
        once: bool = False,
        files_per_batch: int | None = None,
    ) -> StreamingQuery | None:
        """Start the query of one source.

        With ``once`` it works off what has landed and ends; ``finish_run`` closes its run. Without, it polls: each
        poll takes all that has landed, unless ``files_per_batch`` cuts it, and is a run of its own (with
        ``files_per_batch`` the run goes on until ``finish_run``). ``stream_id`` names the checkpoint. Batch numbers restart with a new
        checkpoint, so a new one needs a new ``stream_id``; a batch of other lines under an old key is an error.
        """
        if self.resume(source, since) is None:
            return None

        def store(lines: DataFrame, batch_id: int) -> None:
            self.process(lines, source, f"{stream_id}-{batch_id:012d}")
            if not once and not files_per_batch:
                self.finish_run(source)

        lines = stream_lines(self.spark, landing, files_per_batch)
        if self.drop_relanded is not None:
            lines = once_within(lines, self.drop_relanded)
        writer = (
            lines
            .writeStream.queryName(f"feed-{source}-{stream_id}")
            .foreachBatch(store)
            .option("checkpointLocation", f"{self.root}/checkpoints/{source}/{stream_id}")
        )
        if once:
            writer = writer.trigger(availableNow=True)
        else:
            writer = writer.trigger(processingTime=f"{self.settings.fetch_interval_seconds} seconds")
        return writer.start()

    def run_once(
        self, landings: Mapping[str, str], since: datetime | None = None, stream_id: str = "s0"
    ) -> dict[str, Exception | None]:
        """Ingest what has landed for every source; a failing source does not stop the others."""
        outcome: dict[str, Exception | None] = {}
        queries: dict[str, StreamingQuery] = {}
        for source, landing in landings.items():
            try:
                query = self.start(source, landing, since, stream_id, once=True)
                if query is not None:
                    queries[source] = query
            except Exception as exc:
                logger.exception("source %s did not start", source)
                outcome[source] = exc
        for source, query in queries.items():
            try:
                query.awaitTermination()
                self.finish_run(source)
                outcome[source] = None
            except Exception as exc:
                logger.exception("source %s failed", source)
                outcome[source] = exc
        return outcome


def once_within(lines: DataFrame, time: str) -> DataFrame:
    """Landed lines without those that landed before, within ``time``.

    The state holds a hash for each line until the watermark passes it. A line's time is that of its batch, which is part
    of the query's log, so no line is late whatever its file's time, and a replay sees the same.
    """
    stamped = lines.select("value", F.sha2("value", 256).alias("_hash"), F.current_timestamp().alias("_landed"))
    return stamped.withWatermark("_landed", time).dropDuplicatesWithinWatermark(["_hash"]).select("value")


def _from_micros(micros: int) -> datetime:
    seconds, rest = divmod(micros, 1_000_000)
    return datetime.fromtimestamp(seconds, tz=timezone.utc).replace(microsecond=rest)
