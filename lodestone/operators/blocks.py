"""Documents to blocks: lines or parsed parts, split to a token limit and numbered without gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions import text as T


def line_blocks(docs: DataFrame) -> DataFrame:
    """``doc_id, pos, text``: every line of a document as a block."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    return docs.select("doc_id", F.posexplode(lines).alias("pos", "text"))


def split_blocks(blocks: DataFrame, max_tokens: int = 512) -> DataFrame:
    """``doc_id, sequence, pos, text, block_hash, n_tokens``: stripped blocks, over-long ones cut between sentences."""
    held = blocks.withColumn("text", T.strip(F.col("text"))).where("text <> ''")
    parts = T.pack_greedily(T.sentences(F.col("text")), T.token_estimate, max_tokens, " ")
    whole = F.when(T.token_estimate(F.col("text")) > max_tokens, parts).otherwise(F.array("text"))
    cut = held.select("doc_id", "pos", F.posexplode(whole).alias("part", "text"))
    order = W.partitionBy("doc_id").orderBy("pos", "part")
    return cut.select(
        "doc_id",
        (F.row_number().over(order) - 1).alias("sequence"),
        "pos",
        "text",
        T.block_hash(F.col("text")).alias("block_hash"),
        T.token_estimate(F.col("text")).alias("n_tokens"),
    )


def parse_metrics(blocks: DataFrame) -> DataFrame:
    """``doc_id, n_blocks, char_count, non_printable_ratio, repetition_score`` of stripped, non-empty blocks."""
    held = blocks.select("doc_id", T.strip(F.col("text")).alias("text")).where("text <> ''")
    n = F.count("*")
    joined = F.sum(F.char_length("text")) + n - 1
    return held.groupBy("doc_id").agg(
        n.alias("n_blocks"),
        joined.alias("char_count"),
        F.round(F.sum(T.non_printable(F.col("text"))) / joined, 6).alias("non_printable_ratio"),
        F.round(F.when(n > 1, (n - F.count_distinct("text")) / n).otherwise(F.lit(0.0)), 6).alias("repetition_score"),
    )


def document_metrics(docs: DataFrame) -> DataFrame:
    """What :func:`parse_metrics` gives for the lines of ``doc_id, text``, within each row: no shuffle; rows without a block are left out."""
    lines = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), T.strip), lambda x: x != "")
    held = docs.select("doc_id", F.explode(F.array(lines)).alias("lines")).where(F.size("lines") > 0)  # the generator keeps the lines from being made anew
    n, joined = F.size("lines"), F.char_length(F.array_join("lines", "\n"))
    return held.select(
        "doc_id",
        n.cast("long").alias("n_blocks"),
        joined.cast("long").alias("char_count"),
        F.round(T.non_printable(F.array_join("lines", "\n")) / joined, 6).alias("non_printable_ratio"),
        F.round(F.when(n > 1, (n - F.size(F.array_distinct("lines"))) / n).otherwise(F.lit(0.0)), 6).alias("repetition_score"),
    )


def quality_gates(metrics: DataFrame, min_chars: int | None = 50, max_non_printable: float | None = 0.05, max_repetition: float | None = 0.4) -> DataFrame:
    """``metrics`` with ``reasons`` and ``passed``; a gate set to None is off."""
    gates = []
    if min_chars is not None:
        gates.append(F.when(F.col("char_count") < min_chars, F.lit("too_short")))
    if max_non_printable is not None:
        gates.append(F.when(F.col("non_printable_ratio") > max_non_printable, F.lit("non_printable")))
    if max_repetition is not None:
        gates.append(F.when(F.col("repetition_score") > max_repetition, F.lit("repetitive")))
    reasons = F.array_compact(F.array(*gates)) if gates else F.array().cast("array<string>")
    return metrics.withColumn("reasons", reasons).withColumn("passed", F.size("reasons") == 0)
