"""Attribution, reciprocal-rank fusion, filters, reranking and citations of ranked lists."""

from __future__ import annotations

import functools
import inspect
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.scratch import written

KEY = ["query_id", "chunk_id"]


def source_label(bm25: Column, vector: Column, source: Column) -> Column:
    return F.when(bm25.isNotNull() & vector.isNotNull(), "both").when(bm25.isNotNull(), "bm25_only").when(vector.isNotNull(), "vector_only").otherwise(source)


def attribute(keyword: DataFrame, vector: DataFrame) -> DataFrame:
    """Full outer merge of two ranked lists with where each candidate came from."""
    merged = keyword.select(*KEY, "bm25_score").join(vector.select(*KEY, "vector_score"), KEY, "full_outer")
    both = F.col("bm25_score").isNotNull() & F.col("vector_score").isNotNull()
    return merged.withColumn("retrieval_source", F.when(both, "hybrid").when(F.col("bm25_score").isNotNull(), "bm25").otherwise("vector"))


def rrf(lists: dict[str, DataFrame], k: int = 60, top: int | None = None) -> DataFrame:
    """``query_id, chunk_id, rrf_score, rank, bm25_score, vector_score, retrieval_source``: sum of 1 / (k + rank).

    A candidate is hybrid if every list that has rows for its query holds it, and
    there is more than one such list. Ties go to the smaller id.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    if not lists:
        raise ValueError("no list to fuse")
    rows = None
    for name, ranked in lists.items():
        part = ranked.select(
            *KEY,
            F.lit(name).alias("list"),
            "rank",
            *[F.col(c) if c in ranked.columns else F.lit(None).cast("double").alias(c) for c in ("bm25_score", "vector_score")],
        )
        rows = part if rows is None else rows.unionByName(part)
    rows = written(rows)  # the lists are searched once, though they are counted and summed
    n_lists = rows.groupBy("query_id").agg(F.count_distinct("list").alias("lists"))
    fused = rows.groupBy(*KEY).agg(
        F.round(F.sum(1 / (k + F.col("rank"))), 9).alias("rrf_score"),
        F.count_distinct("list").alias("held_by"),
        F.max("bm25_score").alias("bm25_score"),
        F.max("vector_score").alias("vector_score"),
        F.min("list").alias("first_list"),
    )
    order = W.partitionBy("query_id").orderBy(F.desc("rrf_score"), "chunk_id")
    ranked = fused.join(n_lists, "query_id").select(
        *KEY,
        "rrf_score",
        F.row_number().over(order).alias("rank"),
        "bm25_score",
        "vector_score",
        F.when((F.col("lists") > 1) & (F.col("held_by") == F.col("lists")), "hybrid").otherwise(F.col("first_list")).alias("retrieval_source"),
    )
    return ranked if top is None else ranked.where(F.col("rank") <= top)


def language_filter(candidates: DataFrame, query: str = "query", text: str = "stable_text") -> DataFrame:
    """For queries with CJK characters, drops candidates without any and without a positive keyword score; the best stays if none would.

    Where the text is empty, the one that is shown counts.
    """
    shown = F.coalesce(F.nullif(F.col(text), F.lit("")), F.col("display_text"), F.lit("")) if "display_text" in candidates.columns else F.coalesce(F.col(text), F.lit(""))
    wrong = T.has_cjk(F.col(query)) & ~T.has_cjk(shown) & (F.coalesce("bm25_score", F.lit(0.0)) <= 0)
    marked = candidates.withColumn("fits", ~F.coalesce(wrong, F.lit(False)))
    whole = W.partitionBy("query_id")
    counted = marked.withColumns({"left": F.sum(F.col("fits").cast("int")).over(whole), "first": F.min("rank").over(whole)})
    return counted.where("fits OR (left = 0 AND rank = first)").drop("fits", "left", "first")


def rerank_noop(candidates: DataFrame, top: int) -> DataFrame:
    out = candidates.withColumns({"rerank_score": F.col("rrf_score"), "final_score": F.col("rrf_score")})
    return out.where(F.col("rank") <= top)


def overlap_score(query: Column, text: Column) -> Column:
    """Jaccard similarity of index terms: the offline stand-in for a cross-encoder."""
    a, b = F.array_distinct(T.terms(query)), F.array_distinct(T.terms(text))
    shared = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - shared
    return F.round(F.when(union > 0, shared / union).otherwise(F.lit(0.0)), 6)


def rerank(candidates: DataFrame, score: Column, top: int) -> DataFrame:
    """Best ``top`` by ``score`` (a column over query and text), ties in their old order."""
    scored = candidates.withColumn("rerank_score", score).withColumn("old_rank", F.col("rank"))
    order = W.partitionBy("query_id").orderBy(F.desc("rerank_score"), "old_rank")
    ranked = scored.withColumn("rank", F.row_number().over(order)).withColumn("final_score", F.col("rerank_score"))
    return ranked.where(F.col("rank") <= top)


def rerank_pairs(candidates: DataFrame, model: Callable[[list[tuple[str, str]]], list[float]], top: int, batch: int = 32) -> DataFrame:
    """Best ``top`` by a model that scores (query, text) pairs, ``batch`` at a time in the workers; the text is the stable one, else the shown one."""

    @F.pandas_udf("double")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for queries, texts in parts:
            pairs = list(zip(queries.fillna(""), texts.fillna(""), strict=True))
            yield pd.Series([float(s) for i in range(0, len(pairs), batch) for s in model(pairs[i : i + batch])], dtype=float)

    text = F.coalesce(F.nullif("stable_text", F.lit("")), F.col("display_text")) if "display_text" in candidates.columns else F.col("stable_text")
    return rerank(candidates, run(F.col("query"), text), top)


RERANKERS: dict[str, Callable[..., DataFrame]] = {
    "noop": lambda candidates, top: rerank_noop(candidates, top),
    "overlap": lambda candidates, top: rerank(candidates, overlap_score(F.col("query"), F.col("stable_text")), top),
}


def register_reranker(name: str, reranker: Callable[..., DataFrame]) -> None:
    """Makes ``reranker(candidates, top, **options)`` known by a name."""
    RERANKERS[name] = reranker


def build_reranker(name: str, **options) -> Callable[..., DataFrame]:
    """The named reranker with its options; an unknown name, or options that it does not take, do nothing."""
    chosen = RERANKERS.get(name, RERANKERS["noop"])
    try:
        inspect.signature(chosen).bind(None, 1, **options)
    except TypeError:
        return RERANKERS["noop"]
    return functools.partial(chosen, **options)


def rank_change(before: DataFrame, after: DataFrame) -> DataFrame:
    """``query_id, chunk_id, old_rank, new_rank, change``."""
    moved = after.select(*KEY, F.col("rank").alias("new_rank")).join(before.select(*KEY, F.col("rank").alias("old_rank")), KEY)
    up = F.col("old_rank") - F.col("new_rank")
    change = F.when(up > 0, F.concat(F.lit("▲"), up)).when(up < 0, F.concat(F.lit("▼"), -up)).otherwise("↔")
    return moved.select(*KEY, "old_rank", "new_rank", change.alias("change"))


def citations(candidates: DataFrame, label: str = "source_path", text: str = "display_text") -> DataFrame:
    """``query_id, ref_number, chunk_id, source_label, excerpt``: the rank is the number, the label the path's last part and page."""
    name = F.element_at(F.split(F.coalesce(F.col(label), F.col("chunk_id").cast("string")), "/"), -1)
    if "page" in candidates.columns:
        name = F.when(F.col("page").isNotNull(), F.concat(name, F.lit(" — page "), F.col("page"))).otherwise(name)
    return candidates.select("query_id", F.col("rank").alias("ref_number"), "chunk_id", name.alias("source_label"), F.substring(text, 1, 200).alias("excerpt"))
