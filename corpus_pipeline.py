"""A training corpus from raw documents: quality, near duplicates, benchmark leaks, personal data, sequences.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns of
``documents``, others included; the last returns the packed pieces of the documents that the fourth wrote. Nulls, empty
texts, repeated rows and empty tables follow the operators. The second and third stage judge each text by itself, with or
without id: other texts of an id are documents of their own, and of rows with equal id and text one stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.llm import decontaminate, minhash, packing, pii, quality
from feedloom.llm.common import having_key, new_folder, row_key, table
from feedloom.llm.queries import vocabulary


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier does not reject."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, similarity 0.8 or more) the document with the smallest id.

    24 bands of 4: two sets of similarity 0.80 share no band with a probability of 3e-6.
    """
    return minhash.one_of_each_group(docs, percent=80, bands=24)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that do not contain a benchmark item."""
    units = docs.select(row_key().alias("doc_id"), docs["text"])
    found = decontaminate.contained_items(units, table(spark, sf_dir, "benchmark"))
    return having_key(docs, row_key(), found.select(F.col("doc_id").alias("k")).distinct(), keep=False)


def no_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with personal data replaced by its kind; ``n_chars`` follows the text."""
    clean = pii.redacted(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences of 1024 tokens."""
    return packing.pack_documents(docs, vocabulary(), with_ids=False)


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", one_of_each_group),
    ("decontamination", no_benchmark),
    ("personal_data", no_personal_data),
    ("packing", packed),
]

# Not expressible in SQL: the classifier is fitted, the tokens are those of a vocabulary file.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
