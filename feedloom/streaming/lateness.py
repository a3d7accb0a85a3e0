"""Late rows of a stream, judged per source with keyed state.

A row is late if it is not newer than the resume point of its source. The resume point of a run is the latest time that
earlier runs have seen, so it does not move while a run works off its backlog, however that is cut into batches. Each
source is spread over ``slices`` keys; a key's state is the latest time of its rows, in RocksDB. When a run starts, the state
of the last run is read (one row for each key) and folded to one bound for each source, which is stored, so that a run
which is interrupted goes on with the bounds it began with.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from feedloom.functions.times import utc
from feedloom.sources.files import committed

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SLICES = 32
# The bounds of a run are a literal in every task.
MOST_SOURCES = 100_000


class LatestTime(StatefulProcessor):
    """Marks the rows that are not newer than their source's bound and keeps the latest time of each key."""

    def __init__(self, bounds: dict[str | None, int]) -> None:
        self.bounds = bounds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._latest = handle.getValueState("latest", T.StructType([T.StructField("at", T.LongType())]))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        bound = self.bounds.get(key[0])
        latest = self._latest.get()[0] if self._latest.exists() else None
        for part in rows:
            times = part["at"]
            known = times[times.notna()]
            if len(known):
                latest = int(known.max()) if latest is None else max(latest, int(known.max()))
            # A row without a time is not late.
            part["late"] = (times <= bound).fillna(False).astype(bool) if bound is not None else False
            yield part.drop(columns=["slice", "at"])
        if latest is not None:
            self._latest.update((latest,))

    def close(self) -> None:
        pass


class LatenessStream:
    """Runs over one stream of rows (source, source_id, published_at, ...), kept in ``root``."""

    def __init__(self, spark: SparkSession, root: str, slices: int = SLICES) -> None:
        self.spark, self.root, self.slices = spark, root.rstrip("/"), slices

    def marks(self) -> DataFrame:
        """(source, mark): the latest time that the stream has seen of each source, from its state."""
        none = self.spark.createDataFrame([], "source string, mark long")
        if not committed_batches(self.spark, f"{self.root}/checkpoint"):
            return none
        state = self.spark.read.format("statestore").option("stateVarName", "latest").load(f"{self.root}/checkpoint")
        return state.groupBy(F.col("key.source").alias("source")).agg(F.max("value.at").alias("mark"))

    def bounds(self, run: str, since: datetime | None = None) -> dict[str | None, int]:
        """The resume points of a run, found when it starts and stored; an explicit time counts for every source seen."""
        path = f"{self.root}/bounds/run={run}"
        if not committed(self.spark, path):
            marks = self.marks()
            if since is not None:
                marks = marks.withColumn("mark", F.lit(int(utc(since).timestamp() * 1_000_000)))
            marks.coalesce(1).write.mode("overwrite").parquet(path)
        rows = self.spark.read.schema("source string, mark long").parquet(path).limit(MOST_SOURCES + 1).collect()
        if len(rows) > MOST_SOURCES:
            raise ValueError(f"more than {MOST_SOURCES} sources")
        return {r.source: r.mark for r in rows}

    def run(self, rows: DataFrame, run: str, since: datetime | None = None) -> DataFrame:
        """Work off what the stream holds and return all rows of the run with ``late``."""
        bounds = self.bounds(run, since)
        self.spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
        kept = T.StructType([*[f for f in rows.schema.fields], T.StructField("late", T.BooleanType())])
        keyed = rows.withColumns(
            {"slice": F.pmod(F.xxhash64("source_id"), F.lit(self.slices)).cast("int"), "at": F.unix_micros(F.col("published_at").cast("timestamp"))}
        )
        judged = keyed.groupBy("source", "slice").transformWithStateInPandas(LatestTime(bounds), kept, "Append", "None")
        query = (
            judged.withColumn("run", F.lit(run)).writeStream.format("parquet").partitionBy("run").outputMode("append")
            .option("checkpointLocation", f"{self.root}/checkpoint").option("path", f"{self.root}/rows").trigger(availableNow=True).start()
        )
        query.awaitTermination()
        stored = T.StructType([*kept.fields, T.StructField("run", T.StringType())])
        return self.spark.read.schema(stored).parquet(f"{self.root}/rows").filter(F.col("run") == run).drop("run")


def committed_batches(spark: SparkSession, checkpoint: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/commits/[0-9]*")
    return bool(where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where))


def late_counts(judged: DataFrame) -> DataFrame:
    """(source, n_new, n_late)."""
    return judged.groupBy("source").agg(F.count_if(~F.col("late")).alias("n_new"), F.count_if("late").alias("n_late"))
