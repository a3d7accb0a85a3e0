from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from feedloom.functions import times
from feedloom.operators.marks import resume_points

CASES = {
    "2024": "2024-01-01 00:00:00",
    "2024-05": "2024-05-01 00:00:00",
    "2024-05-06": "2024-05-06 00:00:00",
    "20240506": "2024-05-06 00:00:00",
    "2024-05-06T07:08": "2024-05-06 07:08:00",
    "2024-05-06 07:08:09.123456": "2024-05-06 07:08:09.123456",
    "2024-05-06T07:08:09Z": "2024-05-06 07:08:09",
    "2024-05-06T07:08:09+03:00": "2024-05-06 04:08:09",
    "2024-05-06T07:08:09,5+0300": "2024-05-06 04:08:09.5",
    "20240506T070809Z": "2024-05-06 07:08:09",
    "2024-05-06T07": "2024-05-06 07:00:00",
    "2024-13-01": None,
    "2024-W01": "2024-01-01 00:00:00",
    "2024W017": "2024-01-07 00:00:00",
    "2021-W01-1T10:30:00Z": "2021-01-04 10:30:00",
    "2020-W53-5T01:00:00+03:00": "2020-12-31 22:00:00",
    "2021-W53": None,
    "2024-W00-1": None,
    "2024-W01-8": None,
    "junk": None,
}


def test_parse_iso8601(spark):
    df = spark.createDataFrame(list(enumerate(CASES)), "i int, t string")
    got = df.select("i", times.parse_iso8601("t").cast("string").alias("v")).orderBy("i").collect()
    assert [r.v for r in got] == list(CASES.values())


def test_format_iso_z(spark):
    df = spark.createDataFrame([("2024-05-06 07:08:09",), ("2024-05-06 07:08:09.5",)], "t string")
    got = [r[0] for r in df.select(times.format_iso_z(F.col("t").cast("timestamp"))).collect()]
    assert got == ["2024-05-06T07:08:09Z", "2024-05-06T07:08:09.500000Z"]


def test_resume_points(spark):
    as_of = datetime(2024, 1, 1, tzinfo=timezone.utc)
    names = spark.createDataFrame(
        [("new", None), ("known", None), ("forced", datetime(2023, 1, 1, tzinfo=timezone.utc))],
        "source string, explicit_since timestamp",
    )
    mark = datetime(2023, 12, 31, tzinfo=timezone.utc)
    marks = spark.createDataFrame([("known", mark), ("forced", mark)], "source string, mark timestamp")
    got = {r.source: r.since for r in resume_points(names, marks, as_of, 120).select("source", F.col("since").cast("string").alias("since")).collect()}
    assert got == {
        "new": str((as_of - timedelta(seconds=240)).replace(tzinfo=None)),
        "known": "2023-12-31 00:00:00",
        "forced": "2023-01-01 00:00:00",
    }
