"""The registered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import (
    bpe,
    conversation_repair,
    fill_in_middle,
    license_scan,
    packing,
    passage_dedup,
    quality_classifier,
    quality_rules,
    secret_scan,
    sharding,
    simhash,
    token_counts,
    vector_dedup,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents"), threshold=0.8)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), radius=4, shingle_words=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"), n_shards=40).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        F.col("slot").cast("long"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.apply_policy(quality_rules.ledger(_table(spark, sf_dir, "documents")), "v1")
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_bits")


def op4_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return passage_dedup.remove_repeats(docs, width=50).drop("text")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), vocabulary).drop("name")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=2048)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality_classifier.fit(docs, _table(spark, sf_dir, "labels"))
    return quality_classifier.score(docs, model).select(
        "doc_id",
        quality_classifier.is_held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


def op9_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vector_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"), cosine=0.98)
    return found.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle.transform(_table(spark, sf_dir, "documents").select("doc_id", "text"), seed=7, rate=100, spm_rate=50)
    return made.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fill_in_middle.restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    damaged = conversation_repair.damage(_table(spark, sf_dir, "conversations"))
    return conversation_repair.repair(damaged, copies="copies", digest=True)


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.col("spans")
    return secret_scan.scan(_table(spark, sf_dir, "documents")).select(
        "doc_id",
        *[secret_scan.count_of(spans, kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")],
        F.sha2(secret_scan.joined(secret_scan.base_only(spans)), 256).alias("base_sha256"),
        secret_scan.joined(spans).alias("spans"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_simhash": op2_simhash,
    "op3_sharding": op3_sharding,
    "op4_passage_dedup": op4_passage_dedup,
    "op5_token_counts": op5_token_counts,
    "op6_packing": op6_packing,
    "op7_quality_rules": op7_quality_rules,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_vector_dedup": op9_vector_dedup,
    "op10_bpe": op10_bpe,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_secret_scan": op13_secret_scan,
}
ORACLE_SQL: dict[str, str] = {
    "op1_license_scan": license_scan.scan_sql(0.8),
    "op11_fill_in_middle": fill_in_middle.digests_sql(7, 100, 50),
}
