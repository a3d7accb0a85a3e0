"""Committed folders on any Hadoop file system.

A batch is one folder written by one Spark job. The job's ``_SUCCESS`` file is
the commit: a folder without it does not exist for readers and is overwritten
when the batch is replayed.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


def _filesystem(spark: SparkSession, path: str):
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def committed(spark: SparkSession, pattern: str) -> list[str]:
    """Folders matching the glob ``pattern`` whose job has committed, sorted by name."""
    where, fs = _filesystem(spark, f"{pattern}/_SUCCESS")
    return sorted(status.getPath().getParent().toString() for status in fs.globStatus(where) or [])


def listed(spark: SparkSession, pattern: str) -> list[str]:
    """Folders matching the glob, committed or not, sorted by name."""
    where, fs = _filesystem(spark, pattern)
    return sorted(status.getPath().toString() for status in fs.globStatus(where) or [])


@contextmanager
def claimed(spark: SparkSession, path: str) -> Iterator[None]:
    """Hold a file that only one writer can make; a second one fails at once. After a crash, delete the file."""
    where, fs = _filesystem(spark, path)
    if not fs.createNewFile(where):
        raise RuntimeError(f"another writer holds {path}")
    try:
        yield
    finally:
        fs.delete(where, False)


def make_folder(spark: SparkSession, path: str) -> None:
    where, fs = _filesystem(spark, path)
    fs.mkdirs(where)


def remove(spark: SparkSession, folders: list[str]) -> None:
    for folder in folders:
        where, fs = _filesystem(spark, folder)
        fs.delete(where, True)


def remove_all_but_newest(spark: SparkSession, pattern: str, keep: int) -> None:
    """Delete committed folders matching ``pattern`` except the ``keep`` last written."""
    where, fs = _filesystem(spark, f"{pattern}/_SUCCESS")
    found = sorted(fs.globStatus(where) or [], key=lambda status: status.getModificationTime())
    for status in found[:-keep]:
        fs.delete(status.getPath().getParent(), True)
