"""Run log: append-only tables of runs and their events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stages in the order a trace shows them.
STAGES = ["sniff", "parse", "clean", "split", "pack", "embed", "index", "retrieve", "fuse", "filter", "rerank", "generate", "cite"]


def save_runs(runs: DataFrame, path: str) -> None:
    """Appends ``run_type, metadata (map), created_at`` with an id for each run."""
    rows = runs.withColumn("run_id", F.uuid()) if "run_id" not in runs.columns else runs
    rows.withColumn("metadata_json", F.to_json("metadata")).drop("metadata").write.mode("append").partitionBy("run_type").parquet(path)


def list_runs(spark: SparkSession, path: str, run_type: str | None = None, limit: int = 50) -> DataFrame:
    runs = spark.read.parquet(path)
    chosen = runs if run_type is None else runs.where(F.col("run_type") == run_type)
    return chosen.orderBy(F.desc("created_at"), F.desc("run_id")).limit(limit)


def latest_event(events: DataFrame, event_type: str) -> DataFrame:
    """Last event of a type for each run."""
    rest = [c for c in events.columns if c != "run_id"]
    last = F.max_by(F.struct(*rest), F.struct("created_at", "event_id"))
    return events.where(F.col("event_type") == event_type).groupBy("run_id").agg(last.alias("e")).select("run_id", "e.*")


def by_stage(events: DataFrame) -> DataFrame:
    """``run_id, stage, n_events, latency_ms`` in the fixed order of stages."""
    order = F.array_position(F.array(*map(F.lit, STAGES)), F.col("stage"))
    grouped = events.groupBy("run_id", "stage").agg(F.count("*").alias("n_events"), F.sum("latency_ms").alias("latency_ms"))
    return grouped.withColumn("place", order).orderBy("run_id", "place").drop("place")
