"""The corpus pipeline: quality rules, quality classifier, near-dedup, passage dedup, packing.

Every stage takes ``(spark, docs, sf_dir)``, works on all documents that its
predecessor kept, and returns a DataFrame: documents with their columns, and for
the last stage the packed pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import near_text, packing, passage_dedup, quality_classifier, quality_rules
from lodestone.llm.common import cut

MIN_QUALITY = 0.7


def _plainly_named(stage):
    """The stage on columns whose names none of its own can meet; the caller's names and values come back as they were."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        own = {"doc_id", "text", "n_chars"}
        held = docs.toDF(*[c if c in own else f"column_{i}_of_docs" for i, c in enumerate(docs.columns)])
        return stage(spark, held, sf_dir).select(held.columns).toDF(*docs.columns)

    run.__name__, run.__doc__ = stage.__name__, stage.__doc__
    return run


@_plainly_named
def rule_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules' policy keeps."""
    return quality_rules.apply_policy(quality_rules.ledger(docs), "v1").where("kept")


@_plainly_named
def classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of sufficient score; the model is learnt from the whole table and its labels."""
    model = quality_classifier.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_classifier.score(docs, model, keep=True).where(F.col("quality_score") >= MIN_QUALITY)


@_plainly_named
def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of Jaccard similarity 0.8 or more over five-word shingles, the one of smallest id."""
    return near_text.one_of_each(docs, similarity=0.8, shingle_words=5)


@_plainly_named
def passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 bytes or more that a document of smaller id has; ``n_chars`` follows the text."""
    cleaned = passage_dedup.remove_repeats(docs, width=50)
    return cleaned.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else cleaned


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=2048)


STAGES = [
    ("quality_rules", rule_stage),
    ("quality_classifier", classifier_stage),
    ("near_dedup", near_dedup_stage),
    ("passage_dedup", passage_stage),
    ("packing", packing_stage),
]
#: Fingerprints, learning, refinement and tokenizing are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
