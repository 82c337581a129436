"""Cut points: intermediate results as Parquet in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_OWN: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset, one of this session's own, for a local master only."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="lodestone-core-"))
    return f"file://{_OWN[0]}"


def written(df: DataFrame) -> DataFrame:
    """``df``, computed once and read back, so that several uses share it and lost executors cost no more than a task."""
    path = f"{shared_folder(df.sparkSession)}/written-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def counted(df: DataFrame) -> tuple[DataFrame, int]:
    """:func:`written`, and how many rows it has, counted by the job that writes them."""
    seen = Observation()
    out = written(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return out, seen.get["n"]


def spread(scan: DataFrame) -> DataFrame:
    """A plain scan over twice as many partitions as there are cores, where its files give fewer than cores; a large table stays as it is."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(2 * cores) if scan.rdd.getNumPartitions() < cores else scan
