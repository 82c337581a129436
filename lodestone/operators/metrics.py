"""Retrieval metrics over runs and relevance judgements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def per_query(runs: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """``query_id, n_relevant, hits, recall, mrr, ndcg`` for every query of either side.

    ``runs`` has query_id, chunk_id, rank; ``qrels`` has query_id, chunk_id.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    relevant = qrels.select("query_id", "chunk_id").distinct()
    judged = runs.select("query_id", "chunk_id", "rank").join(relevant.withColumn("rel", F.lit(1)), ["query_id", "chunk_id"], "left")
    near = (F.col("rel") == 1) & (F.col("rank") <= k)
    found = judged.groupBy("query_id").agg(
        F.count_if(near).alias("hits"),
        F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first"),
        F.sum(F.when(near, 1 / F.log2(F.col("rank") + 1))).alias("dcg"),
    )
    counted = relevant.groupBy("query_id").agg(F.count("*").alias("n_relevant"))
    joined = found.join(counted, "query_id", "full_outer").withColumns(
        {"n_relevant": F.coalesce("n_relevant", F.lit(0)), "hits": F.coalesce("hits", F.lit(0))}
    )
    ideal = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.least("n_relevant", F.lit(k)), F.lit(1)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1)
    )
    zero = lambda c: F.round(F.when(F.col("n_relevant") > 0, c).otherwise(F.lit(0.0)), 6)
    return joined.select(
        "query_id",
        "n_relevant",
        "hits",
        zero(F.col("hits") / F.greatest("n_relevant", F.lit(1))).alias("recall"),
        zero(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"),
        zero(F.coalesce(F.col("dcg"), F.lit(0.0)) / ideal).alias("ndcg"),
    )


def macro(metrics: DataFrame) -> DataFrame:
    """Means over queries; zeros without any."""
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6).alias(c)
    return metrics.agg(F.count("*").alias("n_queries"), *[mean(c) for c in ("recall", "mrr", "ndcg")])


def answerable(metrics: DataFrame, cases: DataFrame) -> DataFrame:
    """``metrics`` without the queries that ``cases`` (query_id, expected_behavior) expect to be declined."""
    declined = cases.where(F.col("expected_behavior") == "abstain").select("query_id")
    return metrics.join(declined, "query_id", "left_anti")


def report(metrics: DataFrame, cases: DataFrame, **parts: DataFrame) -> DataFrame:
    """The evaluation as one row: means over answerable queries, and each one-row part as a struct of its name."""
    out = macro(answerable(metrics, cases))
    for name, part in parts.items():
        out = out.crossJoin(F.broadcast(part.select(F.struct(*part.columns).alias(name))))  # one row each
    return out


def write_report(row: DataFrame, path: str) -> None:
    """The one-row report as JSON."""
    row.coalesce(1).write.mode("overwrite").json(path)


def source_attribution(candidates: DataFrame) -> DataFrame:
    """Counts and shares of candidates by label."""
    total = F.greatest(F.count("*"), F.lit(1))
    labels = ("bm25_only", "vector_only", "both")
    return candidates.agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col("source_label") == x).alias(f"n_{x}") for x in labels],
        *[F.round(F.count_if(F.col("source_label") == x) / total, 6).alias(f"share_{x}") for x in labels],
    )


def outcomes(metrics: DataFrame) -> DataFrame:
    """``outcome, n``: SKIP without relevant rows, PASS with a hit, else FAIL."""
    outcome = F.when(F.col("n_relevant") == 0, "SKIP").when(F.col("hits") > 0, "PASS").otherwise("FAIL")
    return metrics.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


def ingest_summary(gated: DataFrame) -> DataFrame:
    """``status, n_docs, n_blocks, chars`` of gated documents: ok, skipped if too short, else error."""
    status = F.when(F.col("passed"), "ok").when(F.array_contains("reasons", "too_short"), "skipped").otherwise("error")
    return gated.groupBy(status.alias("status")).agg(F.count("*").alias("n_docs"), F.sum("n_blocks").alias("n_blocks"), F.sum("char_count").alias("chars"))


def token_saving(packed: DataFrame, candidates: DataFrame) -> DataFrame:
    """Mean of tokens of all candidates less those packed, over queries that have both."""
    whole = candidates.groupBy("query_id").agg(F.sum("token_count").alias("candidate_tokens"))
    used = packed.groupBy("query_id").agg(F.sum("tokens").alias("packed_tokens"))
    return whole.join(used, "query_id").agg(
        F.count("*").alias("n_queries"), F.round(F.avg(F.col("candidate_tokens") - F.col("packed_tokens")), 6).alias("token_saved_est")
    )


def latency(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Mean and the value at place int(0.95 n) of the ascending order.

    The place is found on counts of equal values, so a group may be of any size.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    order = W.partitionBy(*by).orderBy("v")
    total = W.partitionBy(*by)
    placed = counts.withColumns({"upto": F.sum("c").over(order), "n": F.sum("c").over(total)})
    place = F.floor(F.col("n") * 95 / 100)
    hit = (F.col("upto") > place) & (F.col("upto") - F.col("c") <= place)
    return placed.groupBy(*by).agg(
        F.max("n").alias("n"), F.round(F.sum(F.col("v") * F.col("c")) / F.max("n"), 4).alias("mean"), F.max(F.when(hit, F.col("v"))).alias("p95")
    )


def baseline_comparison(macro_row: DataFrame, baselines: dict[str, float]) -> DataFrame:
    """``baseline, baseline_ndcg, ndcg, difference`` against published figures."""
    rows = F.array(*[F.struct(F.lit(n).alias("baseline"), F.lit(v).alias("baseline_ndcg")) for n, v in baselines.items()])
    return macro_row.select("ndcg", F.explode(rows).alias("b")).select(
        "b.baseline", "b.baseline_ndcg", "ndcg", F.round(F.col("ndcg") - F.col("b.baseline_ndcg"), 6).alias("difference")
    )
