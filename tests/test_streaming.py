"""Replays of landed files through the streaming ingest."""

from __future__ import annotations

import json
from datetime import datetime, timedelta, timezone
from functools import partial

import pytest
from pyspark.sql import functions as F

import providers
from feedloom.operators.inference import classify_two_pass
from feedloom.schemas import JobSettings
from feedloom.streaming.ingest import IngestJob
from feedloom.streaming.lateness import LatenessStream, late_counts
from feedloom.streaming.supervise import Supervisor

T0 = datetime(2024, 1, 1, 12, tzinfo=timezone.utc)


class Clock:
    """Later at every look."""

    def __init__(self):
        self.now = T0 + timedelta(hours=1)

    def __call__(self):
        self.now += timedelta(seconds=1)
        return self.now


def submission(i, seconds, text, **more):
    return {"id": str(i), "name": f"t3_{i}", "title": text, "selftext": "", "url": "u", "subreddit": "btc", "author": "ann", "created_utc": T0.timestamp() + seconds} | more


def land(folder, name, records):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text("".join((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in records))


@pytest.fixture
def job(spark, tmp_path):
    return IngestJob(
        spark, str(tmp_path / "store"), classifier=partial(classify_two_pass, provider=providers.GoodChat),
        embedder=providers.TripleEmbedder, clock=Clock(), settings=JobSettings(), model_tasks=2, vector_buckets=3,
    )


def texts(job):
    return {r.source_id: r.text for r in job.store.current().collect()}


def test_batches_marks_and_late_rows(job, tmp_path):
    landing = tmp_path / "reddit"
    land(landing, "1.json", [
        submission(1, 10, "silver fades"), submission(2, 20, "silver fades"), submission(3, 0, "at since"),
        submission(4, 5, "out of order"), "{broken", submission(9, None or 1, "x" * 3, id="i" * 300, name=None),
    ])
    assert job.run_once({"reddit": str(landing)}, since=T0) == {"reddit": None}
    assert texts(job) == {"t3_2": "silver fades", "t3_4": "out of order"}
    row = job.store.current().filter("source_id = 't3_2'").first()
    assert row.topics == ["regulation"] and row.embedding == [0.25, -0.5, 12.0] and row.sentiment == -1
    assert job.mark("reddit") == T0 + timedelta(seconds=20)
    rejected = {tuple(r.violations) for r in job.rejects.read("reddit").collect()}
    assert rejected == {("malformed line",), ("source_id longer than 255",)}

    # A restart from the checkpoint reads only new files; late rows are dropped, an edit wins.
    land(landing, "2.json", [submission(5, 20, "late"), submission(4, 40, "edited"), submission(6, 30, "fresh")])
    assert job.run_once({"reddit": str(landing)}) == {"reddit": None}
    assert texts(job) == {"t3_2": "silver fades", "t3_4": "edited", "t3_6": "fresh"}
    assert job.mark("reddit") == T0 + timedelta(seconds=40)
    edited = job.store.current().filter("source_id = 't3_4'").first()
    assert edited.updated_at > edited.created_at

    # Nothing new: the mark stays.
    job.run_once({"reddit": str(landing)})
    assert job.mark("reddit") == T0 + timedelta(seconds=40)

    # The same text in a later batch takes the stored vector.
    job.embedder = providers.NoNewTexts
    land(landing, "3.json", [submission(7, 50, "fresh")])
    assert job.run_once({"reddit": str(landing)}) == {"reddit": None}
    again = job.store.current().filter("source_id = 't3_7'").first()
    assert again.embedding == [0.25, -0.5, 5.0]


def test_replay_changes_nothing(spark, job, tmp_path):
    landing = tmp_path / "reddit"
    land(landing, "1.json", [submission(1, 10, "one"), submission(2, 20, "two")])
    job.resume("reddit", T0)
    lines = spark.read.text(str(landing))
    job.process(lines, "reddit", "s0-000000000000")
    before = sorted(job.store.current().collect())
    job.classifier, job.embedder = None, providers.NoNewTexts
    job.process(lines, "reddit", "s0-000000000000")
    assert sorted(job.store.current().collect()) == before
    assert job.mark("reddit") == T0 + timedelta(seconds=20)


def test_replay_after_a_failed_model(spark, job, tmp_path):
    """Prepared items are kept, the batch is completed, rows are judged by the mark before it."""
    landing = tmp_path / "reddit"
    land(landing, "1.json", [submission(1, 10, "one")])
    job.resume("reddit", T0)
    lines = spark.read.text(str(landing))
    good = job.classifier

    def broken(items):
        raise RuntimeError("no model")

    job.classifier = broken
    with pytest.raises(RuntimeError):
        job.process(lines, "reddit", "b")
    assert texts(job) == {} and job.mark("reddit") is None and job.run("reddit").bound == T0
    job.classifier = good
    job.process(lines, "reddit", "b")
    assert texts(job) == {"t3_1": "one"}


def test_sources_do_not_stop_each_other(spark, job, tmp_path):
    land(tmp_path / "reddit", "1.json", [submission(1, 10, "one")])
    land(tmp_path / "truth_social", "1.json", [{"id": "1", "content": "two", "created_at": "2024-01-01T12:00:05Z"}])
    process = job.process

    def failing(lines, source, batch_key):
        if source == "reddit":
            raise RuntimeError("feed down")
        process(lines, source, batch_key)

    job.process = failing
    outcome = job.run_once(
        {"reddit": str(tmp_path / "reddit"), "truth_social": str(tmp_path / "truth_social"), "unknown": str(tmp_path)}, since=T0
    )
    assert outcome["truth_social"] is None and "feed down" in str(outcome["reddit"]) and "unknown" not in outcome
    assert {(r.source, r.text) for r in job.store.current().collect()} == {("truth_social", "two")}
    assert not job.run("reddit").closed and job.run("truth_social").closed


def test_resume(job):
    assert job.resume("nope") is None
    first = job.resume("reddit")
    assert first == T0 + timedelta(hours=1, seconds=1) - timedelta(seconds=240)
    assert job.resume("reddit") == first  # an unfinished run keeps its bound
    assert job.resume("reddit", T0 - timedelta(days=1)) == T0 - timedelta(days=1) == job.run("reddit").bound
    for _ in range(12):
        job.finish_run("reddit")
        job.resume("reddit")
    assert job.runs.read("reddit").count() <= 10 and job.run("reddit").bound == T0 - timedelta(days=1)


def stored(job):
    return sorted((r.source_id, r.text, str(r.published_at), str(r.topics)) for r in job.store.current().collect())


POSTS = [
    [submission(1, 50, "newest first"), submission(2, 40, "same text"), submission(3, 30, "edited later")],
    [submission(4, 10, "older, landed later"), submission(5, 5, "same text"), submission(3, 45, "edited")],
    [submission(6, 20, "in between"), submission(7, 60, "same text"), submission(8, -5, "too old"), submission(3, 12, "first words")],
]


@pytest.mark.parametrize("files_per_batch, order", [(None, (0, 1, 2)), (1, (2, 0, 1)), (2, (0, 1, 2))])
def test_content_does_not_depend_on_batches_or_landing_order(job, tmp_path, files_per_batch, order):
    import os

    landing = tmp_path / "reddit"
    for at, i in enumerate(order):
        land(landing, f"{i}.json", POSTS[i])
        os.utime(landing / f"{i}.json", (at + 1, at + 1))
    query = job.start("reddit", str(landing), since=T0, once=True, files_per_batch=files_per_batch)
    query.awaitTermination()
    job.finish_run("reddit")
    wanted = {"t3_1": "newest first", "t3_3": "edited", "t3_4": "older, landed later", "t3_6": "in between", "t3_7": "same text"}
    assert texts(job) == wanted
    assert [r.n_late for r in job.late_counts("reddit").collect()] == [1]
    before = stored(job)
    assert job.compact() == 0 and stored(job) == before
    # An older version of a key in a later run is late and counted.
    land(landing, "9.json", [submission(3, 59, "late"), submission(9, 61, "after the mark")])
    job.run_once({"reddit": str(landing)})
    assert texts(job) == wanted | {"t3_9": "after the mark"}
    assert job.late_counts("reddit").agg(F.sum("n_late")).first()[0] == 2
    assert job.compact() == 1 and texts(job) == wanted | {"t3_9": "after the mark"}
    assert len(list((tmp_path / "store/items/log/source=reddit").glob("run=*/batch=*"))) == 1


def test_an_open_run_is_not_folded(job, tmp_path):
    landing = tmp_path / "reddit"
    land(landing, "1.json", POSTS[0])
    job.start("reddit", str(landing), since=T0, once=True).awaitTermination()
    assert job.compact() == -1 and len(texts(job)) == 3
    # The run goes on after a restart: its bound has not moved.
    land(landing, "2.json", POSTS[1])
    job.start("reddit", str(landing), once=True).awaitTermination()
    assert texts(job)["t3_4"] == "older, landed later" and texts(job)["t3_3"] == "edited"


def test_a_batch_key_used_for_other_lines_is_refused(spark, job, tmp_path):
    land(tmp_path / "a", "1.json", [submission(1, 10, "one")])
    land(tmp_path / "b", "1.json", [submission(2, 20, "two")])
    job.resume("reddit", T0)
    job.process(spark.read.text(str(tmp_path / "a")), "reddit", "s0-0")
    with pytest.raises(ValueError, match="stream_id"):
        job.process(spark.read.text(str(tmp_path / "b")), "reddit", "s0-0")
    assert texts(job) == {"t3_1": "one"}


def test_a_time_in_the_future_does_not_close_a_source(job, tmp_path):
    landing = tmp_path / "reddit"
    land(landing, "1.json", [submission(1, 10, "one"), submission(2, 3e9, "from 2119")])
    job.run_once({"reddit": str(landing)}, since=T0)
    assert job.mark("reddit") <= job.clock.now
    land(landing, "2.json", [submission(3, 3700, "an hour later")])
    job.run_once({"reddit": str(landing)})
    assert texts(job)["t3_3"] == "an hour later"


def test_long_texts_are_stored_whole(job, tmp_path):
    head = " ".join(f"w{i}" for i in range(1500))
    land(tmp_path / "reddit", "1.json", [submission(1, 10, "", selftext=f"{head} a"), submission(2, 20, "", selftext=f"{head} b")])
    job.run_once({"reddit": str(tmp_path / "reddit")}, since=T0)
    assert texts(job) == {"t3_1": f"{head} a", "t3_2": f"{head} b"}


def test_repeated_polls(job, tmp_path):
    """A running query with a trigger interval picks up files as they land."""
    landing = tmp_path / "reddit"
    land(landing, "1.json", [submission(1, 10, "one")])
    job.settings = JobSettings(fetch_interval_seconds=1)
    query = job.start("reddit", str(landing), since=T0)
    try:
        query.processAllAvailable()
        land(landing, "2.json", [submission(2, 20, "two")])
        query.processAllAvailable()
    finally:
        query.stop()
    assert texts(job) == {"t3_1": "one", "t3_2": "two"}
    job.finish_run("reddit")
    assert job.compact() == 0
    assert job.store.current().select(F.countDistinct("id")).first()[0] == 2


def test_old_vectors_are_not_looked_up(job, tmp_path):
    landing = tmp_path / "reddit"
    land(landing, "1.json", [submission(1, 10, "one")])
    job.run_once({"reddit": str(landing)}, since=T0)
    job.vector_lookback = timedelta(0)
    land(landing, "2.json", [submission(2, 20, "one")])
    job.run_once({"reddit": str(landing)})
    assert job.vectors.read("reddit").count() == 2
    job.compact_vectors("reddit")
    assert job.vectors.read("reddit").count() == 1
    assert texts(job) == {"t3_1": "one", "t3_2": "one"}


def statuses(*rows):
    return [{"id": str(i), "content": text, "created_at": f"2024-01-01T12:00:{s:02d}Z"} for i, s, text in rows]


def test_a_failing_source_recovers_and_stops_no_other(job, tmp_path):
    land(tmp_path / "reddit", "1.json", [submission(1, 10, "one")])
    land(tmp_path / "truth_social", "1.json", statuses((1, 5, "two")))
    process, calls = job.process, []

    def failing(lines, source, batch_key):
        calls.append(source)
        if source == "reddit" and calls.count("reddit") <= 2:
            raise RuntimeError("feed down")
        process(lines, source, batch_key)

    job.process = failing
    landings = {"reddit": str(tmp_path / "reddit"), "truth_social": str(tmp_path / "truth_social"), "unknown": "x", "telegram": str(tmp_path / "nothing")}
    boss = Supervisor(job, landings, interval=0.2, first_pause=0.05, since=T0)
    (tmp_path / "nothing").mkdir()
    health = boss.run(polls=2)
    assert set(health) == {"reddit", "truth_social", "telegram"}
    assert (health["reddit"].failures, health["reddit"].failures_in_a_row, health["reddit"].last_error) == (2, 0, None)
    assert health["truth_social"].failures == 0 and all(h.polls >= 2 for h in health.values())
    assert calls.count("reddit") == 3 and calls.count("truth_social") == 1
    assert {(r.source, r.text) for r in job.store.current().collect()} == {("reddit", "one"), ("truth_social", "two")}
    assert job.run("reddit").closed and job.run("truth_social").closed
    # The log of a polling source is folded between polls.
    boss = Supervisor(job, {"reddit": str(tmp_path / "reddit")}, interval=0.05, compact_every=1)
    land(tmp_path / "reddit", "2.json", [submission(2, 20, "three")])
    boss.run(polls=1)
    assert job.store.version() >= 0 and job.store._waiting(job.store.version()) == []
    assert boss.pause_after(1) == 1.0 and boss.pause_after(3) == 4.0 and boss.pause_after(99) == 900.0


def test_a_missing_folder_is_a_failed_poll(job, tmp_path):
    land(tmp_path / "reddit", "1.json", [submission(1, 10, "one")])
    boss = Supervisor(job, {"reddit": str(tmp_path / "reddit"), "truth_social": str(tmp_path / "later")}, interval=0.05, first_pause=0.05, since=T0)
    boss.step()
    assert boss.health["truth_social"].failures == 1 and "later" in boss.health["truth_social"].last_error
    land(tmp_path / "later", "1.json", statuses((1, 5, "two")))
    health = boss.run(polls=1)
    assert health["truth_social"].polls == 1 and health["truth_social"].failures_in_a_row == 0
    assert len(texts(job)) == 2


@pytest.mark.parametrize("fold", [False, True])
def test_content_does_not_depend_on_folds_between_polls(job, tmp_path, fold):
    landing = tmp_path / "reddit"
    job.settings = JobSettings(fetch_interval_seconds=1)
    query = job.start("reddit", str(landing_with(landing, "1.json", [submission(11, 10, "equal"), submission(5, 5, "x")])), since=T0)
    try:
        query.processAllAvailable()
        if fold:
            job.finish_run("reddit")
            job.compact()
        land(landing, "2.json", [submission(12, 20, "equal"), submission(5, 15, "y"), submission(6, 9, "late")])
        query.processAllAvailable()
    finally:
        query.stop()
    assert texts(job) == {"t3_11": "equal", "t3_12": "equal", "t3_5": "y"}
    assert job.run("reddit").closed and job.late.read("reddit").count() == 1
    row = job.store.current().filter("source_id = 't3_5'").first()
    assert row.updated_at > row.created_at
    job.compact()
    assert texts(job) == {"t3_11": "equal", "t3_12": "equal", "t3_5": "y"} and job.store._waiting(job.store.version()) == []


def landing_with(folder, name, records):
    land(folder, name, records)
    return folder


def test_a_batch_never_joins_a_finished_run(spark, job, tmp_path):
    land(tmp_path / "a", "1.json", [submission(1, 10, "one")])
    land(tmp_path / "b", "1.json", [submission(2, 20, "one"), submission(3, 8, "late")])
    job.resume("reddit", T0)
    job.process(spark.read.text(str(tmp_path / "a")), "reddit", "s0-0")
    first = job.run("reddit").name
    job.finish_run("reddit")
    job.compact()
    job.process(spark.read.text(str(tmp_path / "b")), "reddit", "s0-1")
    assert job.run("reddit").name > first and job.run("reddit").bound == T0 + timedelta(seconds=10)
    assert texts(job) == {"t3_1": "one", "t3_2": "one"}


def test_an_outage_stores_nothing_and_the_replay_is_whole(job, tmp_path):
    landing = landing_with(tmp_path / "reddit", "1.json", [submission(i, i, f"text {i}") for i in range(1, 30)])
    job.embedder = providers.DownEmbedder
    job.classifier = partial(classify_two_pass, provider=providers.GoodChat, pause=providers.no_pause)
    outcome = job.run_once({"reddit": str(landing)}, since=T0)
    assert "ProviderDown" in str(outcome["reddit"]) and texts(job) == {} and job.mark("reddit") is None
    job.embedder = providers.TripleEmbedder
    assert job.run_once({"reddit": str(landing)}) == {"reddit": None}
    rows = job.store.current().collect()
    assert len(rows) == 29 and all(r.embedding is not None and r.sentiment == -1 for r in rows)


def test_failed_items_are_asked_again(job, tmp_path):
    landing = landing_with(tmp_path / "reddit", "1.json", [submission(1, 10, "bad one"), submission(2, 20, "good"), submission(3, 30, "never")])
    job.embedder = providers.PickyEmbedder
    job.classifier = partial(classify_two_pass, provider=providers.MoodyChat, pause=providers.no_pause)
    job.run_once({"reddit": str(landing)}, since=T0)
    before = {r.source_id: r for r in job.store.current().collect()}
    assert before["t3_1"].embedding is None and before["t3_3"].sentiment is None
    job.compact()
    job.embedder = providers.TripleEmbedder
    job.classifier = partial(classify_two_pass, provider=providers.GoodChat)
    assert job.ask_again("reddit") == 2
    after = {r.source_id: r for r in job.store.current().collect()}
    assert after["t3_1"].embedding == [0.25, -0.5, 7.0] and after["t3_3"].sentiment == -1
    assert after["t3_2"] == before["t3_2"] and after["t3_3"].embedding == before["t3_3"].embedding
    assert job.ask_again("reddit") == 0 and job.mark("reddit") == T0 + timedelta(seconds=30)
    job.compact()
    assert {r.source_id: r.text for r in job.store.current().collect()} == {"t3_1": "bad one", "t3_2": "good", "t3_3": "never"}


def test_observed_counts_equal_the_tables(spark, job, tmp_path):
    job.embedder = providers.PickyEmbedder
    job.classifier = partial(classify_two_pass, provider=providers.MoodyChat, pause=providers.no_pause)
    landing = landing_with(tmp_path / "reddit", "1.json", [submission(1, 10, "bad one"), submission(2, 20, "good"), submission(3, 21, "good"), submission(4, -1, "old"), "{broken"])
    job.run_once({"reddit": str(landing)}, since=T0)
    land(landing, "2.json", [submission(5, 30, "good"), submission(6, 31, "never"), submission(7, 5, "late"), submission(8, 6, "late too")])
    job.run_once({"reddit": str(landing)})
    got = {r.batch: r for r in job.batch_metrics("reddit").collect()}
    for batch, row in got.items():
        stored = job.store.read_batch("reddit", batch).collect()
        assert row.stored == len(stored) and row.reused == sum(r.embedding_reused for r in stored)
        assert row.failed == sum(r.classification_error is not None or r.embedding_error is not None for r in stored)
        assert row.late == job.late.read_batch("reddit", batch).count() and row.rejected == job.rejects.read_batch("reddit", batch).count()
        assert row.latest == max(int(r.published_at.timestamp() * 1e6) for r in stored)
    assert [(r.stored, r.reused, r.failed, r.late, r.rejected) for _, r in sorted(got.items())] == [(2, 0, 1, 1, 1), (2, 1, 1, 2, 0)]
    # A replay whose prepared rows were there already counts the same, from the tables.
    batch = sorted(got)[1]
    job.prepared.clear("none")
    from feedloom.sources.files import remove

    remove(spark, [job.counts.path("reddit", batch), *job.store._stored("reddit", batch)])
    job.process(spark.read.text(str(landing / "2.json")), "reddit", batch)
    assert job.counts.read_batch("reddit", batch).first().asDict() == {k: v for k, v in got[batch].asDict().items() if k != "batch"}


def test_lines_that_land_again_are_passed_over_after_a_restart(job, tmp_path):
    job.drop_relanded = "7 days"
    landing = landing_with(tmp_path / "reddit", "1.json", [submission(1, 10, "one"), submission(1, 10, "one"), submission(2, 20, "two")])
    assert job.run_once({"reddit": str(landing)}, since=T0) == {"reddit": None}
    land(landing, "2.json", [submission(2, 20, "two"), submission(3, 30, "three"), submission(1, 40, "edited")])
    assert job.run_once({"reddit": str(landing)}) == {"reddit": None}
    # Batches without data, which only move the watermark, store nothing.
    assert sum(r.stored for r in job.batch_metrics("reddit").collect()) == 4 and job.late.read("reddit").count() == 0
    assert texts(job) == {"t3_1": "edited", "t3_2": "two", "t3_3": "three"}
    assert IngestJob.drop_relanded is None


LATE_ROW = "source string, source_id string, published_at timestamp, note string"


def landed(spark, folder, name, rows):
    times = [(s, i, None if t is None else T0 + timedelta(seconds=t), "n") for s, i, t in rows]
    spark.createDataFrame(times, LATE_ROW).coalesce(1).write.parquet(str(folder / name))


def test_keyed_lateness_holds_its_bounds_for_a_run(spark, tmp_path):
    stream = spark.readStream.schema(LATE_ROW).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/landing/*")
    judge = LatenessStream(spark, str(tmp_path / "job"), slices=3)
    assert judge.marks().count() == 0
    landed(spark, tmp_path / "landing", "1", [("a", "1", 50), ("a", "2", 10), ("b", "3", 5), (None, "9", 7)])
    landed(spark, tmp_path / "landing", "2", [("a", "4", 20), ("b", "5", None), ("a", "6", 60)])
    first = judge.run(stream, "r1")
    assert first.columns == ["source", "source_id", "published_at", "note", "late"]
    # Without a mark nothing is late, in whatever order the files land.
    assert first.filter("late").count() == 0 and first.count() == 7
    base = int(T0.timestamp() * 1e6)
    assert {r.source: r.mark for r in judge.marks().collect()} == {"a": base + 60_000_000, "b": base + 5_000_000, None: base + 7_000_000}
    # The bounds of the second run are stored when it starts and stay, also after an interruption.
    assert judge.bounds("r2") == {"a": base + 60_000_000, "b": base + 5_000_000, None: base + 7_000_000}
    landed(spark, tmp_path / "landing", "3", [("a", "7", 100), ("a", "8", 60), ("c", "10", 1), (None, "11", 7)])
    judge.run(stream, "r2")
    landed(spark, tmp_path / "landing", "4", [("a", "12", 70), ("b", "13", 5), ("b", "14", 6), ("c", "15", 0), ("a", "16", None)])
    second = LatenessStream(spark, str(tmp_path / "job"), slices=3).run(stream, "r2")
    assert {r.source_id for r in second.filter("late").collect()} == {"8", "11", "13"} and second.count() == 9
    assert {(r.source, r.n_new, r.n_late) for r in late_counts(second).collect()} == {("a", 3, 1), ("b", 1, 1), ("c", 2, 0), (None, 0, 1)}
    landed(spark, tmp_path / "landing", "5", [("a", "17", 80), ("c", "18", 1)])
    third = judge.run(stream, "r3", since=T0 + timedelta(seconds=90))
    assert {r.source_id: r.late for r in third.collect()} == {"17": True, "18": True}
