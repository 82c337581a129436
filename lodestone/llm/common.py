"""Shared pieces of the operators: written cut points and connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIR: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a fresh local one only for a local master (tests)."""
    set_dir = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _OWN_DIR:
        _OWN_DIR.append(tempfile.mkdtemp(prefix="lodestone-"))
    return "file://" + _OWN_DIR[0]


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` once as Parquet in the shared folder and reads it back.

    The lineage ends at files that outlive executors; nothing is computed twice.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an undirected graph.

    ``edges`` has two long columns ``a`` and ``b``. Returns ``node, component``
    (the smallest node of its component) for every node that has an edge to
    another node; nodes without one are their own component and are left out.
    Null ends and self-loops are ignored, repeated edges are harmless.

    Every round hooks each node onto its smallest neighbour, jumps twice along
    the hooks and contracts the edges, so stars and long paths both shrink
    geometrically. Each round is written out; the joins read written tables on
    both sides, so a hub with many edges is split by adaptive skew handling.
    """
    graph = cut(
        edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )
    levels: list[DataFrame] = []
    while not graph.isEmpty():
        both = graph.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(
            graph.select(F.col("b").alias("node"), F.col("a").alias("other"))
        )
        hook = cut(both.groupBy("node").agg(F.least("node", F.min("other")).alias("up")))
        for _ in range(2):
            above = hook.select(F.col("node").alias("up"), F.col("up").alias("upper"))
            hook = cut(hook.join(above, "up").select("node", F.col("upper").alias("up")))
        levels.append(hook)
        left = hook.select(F.col("node").alias("a"), F.col("up").alias("ua"))
        right = hook.select(F.col("node").alias("b"), F.col("up").alias("ub"))
        moved = cut(graph.join(left, "a").select("ua", "b"))
        graph = cut(
            moved.join(right, "b")
            .where("ua <> ub")
            .select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b"))
            .distinct()
        )
    if not levels:
        return graph.select(F.col("a").alias("node"), F.col("b").alias("component"))
    found = levels[-1].select("node", F.col("up").alias("component"))
    for level in reversed(levels[:-1]):
        found = cut(
            level.join(found.withColumnRenamed("node", "up"), "up", "left").select(
                "node", F.coalesce("component", "up").alias("component")
            )
        )
    return found
