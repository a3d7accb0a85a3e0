"""Session settings the library relies on."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings; all can be changed on a running session.
REQUIRED_CONF = {
    # Every timestamp in the item model is UTC.
    "spark.sql.session.timeZone": "UTC",
    # A repeated key in a JSON answer keeps its last value, as json.loads does.
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A Python task gets texts of about so many bytes at once; its working memory is a multiple of them.
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
}


def apply_settings(spark: SparkSession) -> SparkSession:
    for key, value in REQUIRED_CONF.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach for written intermediate tables, as a URI.

    The session names it in ``spark.checkpoint.dir``; a cluster's folder, and for a local session one of the caller's choice.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    where = spark._jvm.org.apache.hadoop.fs.Path(named)
    full = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()
    return full.replace("file:/", "file:///", 1) if full.startswith("file:/") and not full.startswith("file://") else full


def staged(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder and read back: what is read twice is computed once."""
    path = f"{shared_dir(df.sparkSession)}/staged/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
