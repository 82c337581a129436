"""Set-based change detection: diff, guardrail, resync, upsert and removal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def early_skip(incoming: DataFrame, known: DataFrame, key: str = "doc_key") -> DataFrame:
    """Rows of ``incoming`` that ``known`` does not hold."""
    return incoming.join(known.select(key).distinct(), key, "left_anti")


def latest_version(documents: DataFrame, path: str = "source_path", order: str = "ingest_seq") -> DataFrame:
    """The row of the highest ``order`` for each path; ties go to the larger ``doc_id``."""
    rest = [c for c in documents.columns if c != path]
    last = F.max_by(F.struct(*rest), F.struct(order, "doc_id"))
    return documents.groupBy(path).agg(last.alias("row")).select(path, "row.*")


def diff_blocks(old: DataFrame, new: DataFrame, key: list[str], value: str = "block_hash") -> DataFrame:
    """``new`` rows marked unchanged or added, and ``old`` rows marked removed; repeated rows stay repeated."""
    on = [*key, value]
    in_old = old.select(*on).distinct().withColumn("held", F.lit(True))
    in_new = new.select(*on).distinct()
    marked = new.select(*on).join(in_old, on, "left").select(*on, F.when(F.col("held"), "unchanged").otherwise("added").alias("status"))
    return marked.unionByName(old.select(*on).join(in_new, on, "left_anti").withColumn("status", F.lit("removed")))


def guardrail(diff: DataFrame, key: list[str], warning: float = 0.5, error: float = 0.9) -> DataFrame:
    """Counts by status, the changed share, and ``level`` none, warning or error for each key."""
    counted = diff.groupBy(*key).agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("unchanged", "added", "removed")])
    ratio = (F.col("added") + F.col("removed")) / (F.col("unchanged") + F.col("added") + F.col("removed"))
    level = F.when(ratio >= error, "error").when(ratio >= warning, "warning").otherwise("none")
    return counted.withColumns({"change_ratio": F.round(ratio, 6), "level": level})


def resync(old: DataFrame, new: DataFrame, window: int = 1, fallback: float | None = None) -> DataFrame:
    """``new`` (``doc_id, pos, chunk_signature``) with ``action`` reuse or reembed.

    A chunk whose signature is new, and ``window`` neighbours on either side, are
    embedded again; where that is ``fallback`` of a document or more, all are.
    A reused chunk takes the old ``embedding`` along, where ``old`` has one.
    """
    if window < 0:
        raise ValueError("window must not be negative")
    if fallback is not None and not 0 < fallback <= 1:
        raise ValueError("fallback must lie in (0, 1]")
    carried = [F.first("embedding").alias("embedding")] if "embedding" in old.columns else []
    known = old.groupBy("doc_id", "chunk_signature").agg(F.lit(True).alias("known"), *carried)
    near = W.partitionBy("doc_id").orderBy("pos").rowsBetween(-window, window)
    joined = new.join(known, ["doc_id", "chunk_signature"], "left")
    again = F.max(F.col("known").isNull().cast("int")).over(near) == 1
    marked = joined.withColumn("again", again)
    if fallback is not None:
        share = F.avg(F.col("again").cast("int")).over(W.partitionBy("doc_id"))
        marked = marked.withColumn("again", F.col("again") | (share >= fallback))
    out = marked.withColumn("action", F.when(F.col("again"), "reembed").otherwise("reuse"))
    if carried:
        out = out.withColumn("embedding", F.when(~F.col("again"), F.col("embedding")))
    return out.drop("again", "known")


def resync_stats(actions: DataFrame) -> DataFrame:
    """Counts of actions and the share saved, for each document."""
    reused, all_ = F.count_if(F.col("action") == "reuse"), F.count("*")
    return actions.groupBy("doc_id").agg(
        reused.alias("reused"), (all_ - reused).alias("reembed"), F.round(reused / all_, 6).alias("savings_ratio")
    )


def stale_chunks(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of the previous version that the new one no longer has."""
    return old.join(new.select(*key).distinct(), key, "left_anti")


def upsert(table: DataFrame, rows: DataFrame, key: list[str], order: Column | None = None) -> DataFrame:
    """``table`` with ``rows`` put in place of those of equal key; of rows repeating a key the last in ``order`` wins."""
    if order is not None:
        rows = rows.withColumn("nth", F.row_number().over(W.partitionBy(*key).orderBy(order.desc()))).where("nth = 1").drop("nth")
    else:
        rows = rows.dropDuplicates(key)
    return table.join(rows.select(*key), key, "left_anti").unionByName(rows.select(table.columns))


def delete_documents(tables: dict[str, DataFrame], doc_ids: DataFrame) -> dict[str, DataFrame]:
    """Each table without the rows of the named documents."""
    gone = doc_ids.select("doc_id").distinct()
    return {name: table.join(gone, "doc_id", "left_anti") for name, table in tables.items()}
