"""Polls of all sources, again and again, in one driver: a source that fails is tried again and stops no other.

Each poll is a query of its own that works off what has landed (``availableNow``) and ends, so it is one run of its
source, closed when the backlog is empty. A poll that fails leaves its run open; the next attempt replays the batch
that failed, after a pause that doubles with every failure in a row. ``awaitAnyTermination`` wakes the loop as soon as
one query ends. Nothing but a few numbers per source is held here: a new supervisor goes on from the checkpoints.
"""

from __future__ import annotations

import logging
import threading
import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.errors import PySparkException
from pyspark.sql.streaming import StreamingQuery

from feedloom.streaming.ingest import IngestJob

logger = logging.getLogger(__name__)

# Seconds between two looks at the queries, if none ends before.
LONGEST_WAIT = 5.0


@dataclass
class Health:
    """How a source is doing."""

    source: str
    due: float
    polls: int = 0
    failures: int = 0
    failures_in_a_row: int = 0
    last_error: str | None = None
    query: StreamingQuery | None = field(default=None, repr=False)


class Supervisor:
    """Polls ``landings`` (source -> folder) with a job until told to stop."""

    def __init__(
        self,
        job: IngestJob,
        landings: Mapping[str, str],
        interval: float | None = None,
        first_pause: float = 1.0,
        longest_pause: float = 900.0,
        since: datetime | None = None,
        stream_id: str = "s0",
        files_per_batch: int | None = None,
        compact_every: int | None = None,
        now: Callable[[], float] = time.monotonic,
    ) -> None:
        self.job, self.landings = job, dict(landings)
        self.interval = job.settings.fetch_interval_seconds if interval is None else interval
        self.first_pause, self.longest_pause = first_pause, longest_pause
        self.since, self.stream_id, self.files_per_batch = since, stream_id, files_per_batch
        self.compact_every, self.now = compact_every, now
        self.stopped = threading.Event()
        unknown = [s for s in self.landings if s not in job.feeds]
        for source in unknown:
            logger.warning("unknown source %s", source)
        self.health = {s: Health(s, now()) for s in self.landings if s not in unknown}
        self._since_compaction = 0

    def run(self, polls: int | None = None) -> dict[str, Health]:
        """Poll until ``stop``, or until every source has had so many polls that did not fail."""
        while not self.stopped.is_set():
            self.step(polls)
            if polls is not None and all(h.polls >= polls and h.query is None for h in self.health.values()):
                break
            self._wait()
        for h in self.health.values():
            if h.query is not None:
                # Started polls are finished and not cut off.
                self._ended(h, _outcome(h.query))
        return self.health

    def stop(self) -> None:
        self.stopped.set()

    def step(self, polls: int | None = None) -> None:
        """Take note of the polls that ended and start those that are due, of sources with fewer than ``polls``."""
        for h in self.health.values():
            if h.query is not None and not h.query.isActive:
                self._ended(h, _outcome(h.query))
            if h.query is None and self.now() >= h.due and (polls is None or h.polls < polls):
                self._start(h)

    def pause_after(self, failures: int) -> float:
        return min(self.longest_pause, self.first_pause * 2 ** min(failures - 1, 60))

    def _start(self, h: Health) -> None:
        try:
            # An explicit time counts for the first poll only, also when that has to be repeated.
            fresh = self.since is not None and h.polls == 0 and h.failures == 0
            h.query = self.job.start(h.source, self.landings[h.source], self.since if fresh else None, self.stream_id, once=True, files_per_batch=self.files_per_batch)
        except Exception as exc:
            self._ended(h, exc)

    def _ended(self, h: Health, error: Exception | None) -> None:
        h.query = None
        if error is None:
            try:
                self.job.finish_run(h.source)
                self._compact()
            except Exception as exc:
                error = exc
        if error is None:
            h.polls, h.failures_in_a_row, h.last_error = h.polls + 1, 0, None
            h.due = self.now() + self.interval
            return
        h.failures += 1
        h.failures_in_a_row += 1
        h.last_error = f"{type(error).__name__}: {error}"
        pause = self.pause_after(h.failures_in_a_row)
        h.due = self.now() + pause
        logger.warning("poll of %s failed %d times in a row, next in %.0f s: %s", h.source, h.failures_in_a_row, pause, error)

    def _compact(self) -> None:
        self._since_compaction += 1
        if self.compact_every and self._since_compaction >= self.compact_every:
            self._since_compaction = 0
            self.job.compact()

    def _wait(self) -> None:
        """Until a query ends or the next poll is due."""
        idle = [h.due for h in self.health.values() if h.query is None]
        seconds = max(0.01, min([LONGEST_WAIT, *(d - self.now() for d in idle)]))
        if any(h.query is not None for h in self.health.values()):
            streams = self.job.spark.streams
            try:
                streams.awaitAnyTermination(int(max(1, seconds)))
            except PySparkException:
                pass  # told apart by query in step()
            streams.resetTerminated()
        else:
            self.stopped.wait(seconds)


def _outcome(query: StreamingQuery) -> Exception | None:
    try:
        query.awaitTermination()
    except Exception as exc:
        return exc
    return None
