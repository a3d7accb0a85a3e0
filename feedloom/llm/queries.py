"""The registered queries of this folder: each operator over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.llm import chat, clusters, decontaminate, minhash, packing, pii, quality, secret_scan, suffixes, toxicity, vectors, warc, whitening
from feedloom.llm.common import table


def vocabulary() -> packing.Vocabulary:
    import public_tokenizers as files

    return packing.Vocabulary(files.path("byte_bpe_50k.json"), files.path("byte_bpe_50k.tiktoken"), files.PATTERN)


def rank_file() -> secret_scan.RankFile:
    import public_tokenizers as files

    return secret_scan.RankFile(files.path("byte_bpe_50k.tiktoken"), files.PATTERN)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.encode("html", "UTF-8").alias("payload"))
    return warc.round_trip(spark, pages, min_revisit_bytes=0).select(
        F.col("record_id").try_cast("long").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").try_cast("long").alias("refers_to"),
    )


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary(), with_ids=False)


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op8_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated_bytes(table(spark, sf_dir, "documents"), length=50)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    control = chat.END.strip() + chat.START + "assistant ok"
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(control).alias("text"),
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    examples = chat.chat_examples(turns)
    # From here on only what the formatted examples hold.
    read = examples.select(
        "conv_id",
        "example",
        "formatted",
        F.when(F.col("loss_start").isNotNull(), chat.loss_text(F.col("formatted"), F.col("loss_start"), F.col("loss_end"))).alias("loss"),
    )
    per_conv = read.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("longest"),
        F.sort_array(F.collect_list(F.when(F.col("loss").isNotNull(), F.struct("example", "loss")))).alias("losses"),
        F.sum(F.length("formatted")).cast("long").alias("formatted_chars"),
    )
    turn = F.transform("messages", lambda m: F.concat(m["role"], F.lit("\n"), m["text"], F.lit("\n")))
    loss = F.array_join("losses.loss", "")
    return per_conv.select("conv_id", chat.messages_of(F.col("longest")).alias("messages"), "losses", "formatted_chars").select(
        "conv_id",
        F.size("messages").cast("long").alias("n_turns"),
        F.sha2(F.array_join(turn, ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"), components=4)


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.clustered(table(spark, sf_dir, "embeddings"), k=40, rounds=5, size=64, salt="2:")


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secrets(table(spark, sf_dir, "documents"), rank_file())


QUERIES = {
    "op1_warc": op1_warc,
    "op2_packing": op2_packing,
    "op3_pii": op3_pii,
    "op4_toxicity": op4_toxicity,
    "op5_minhash": op5_minhash,
    "op6_quality": op6_quality,
    "op7_vectors": op7_vectors,
    "op8_suffixes": op8_suffixes,
    "op9_decontaminate": op9_decontaminate,
    "op10_chat": op10_chat,
    "op11_whitening": op11_whitening,
    "op12_centroids": op12_centroids,
    "op13_secrets": op13_secrets,
}
