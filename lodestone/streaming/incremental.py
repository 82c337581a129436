"""Incremental ingest of a stream of documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.plans.engine import Engine
from lodestone.scratch import written

DOCUMENTS = "source_path string, text string, collection string"


def document_stream(spark: SparkSession, path: str, schema: str = DOCUMENTS, files_per_batch: int = 100) -> DataFrame:
    """Documents of new Parquet files under a path."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def ingest_stream(engine: Engine, stream: DataFrame, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Ingests each micro-batch; a batch that is run again finds its documents stored and skips them."""

    def step(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            engine.ingest(batch)

    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def sync_stream(engine: Engine, connector: str, items: DataFrame, convert: Callable[[DataFrame], DataFrame], checkpoint: str) -> StreamingQuery:
    """Ingests the items of a registered connector (see :mod:`lodestone.sources.paged`) batch by batch, until none is left.

    ``convert`` makes artifacts of items. Items that could not be fetched, and artifacts that say ``error/...``, become dead letters in
    the same commit as the documents. The cursor is the query's own offset, in its checkpoint; a batch that is run again finds its documents stored.
    """

    def step(batch: DataFrame, _: int) -> None:
        rows = written(batch)
        made = written(convert(rows.where("error IS NULL")))
        engine.land(connector, made, rows.where("error IS NOT NULL").select("source_id", "cursor_after", F.col("error").alias("reason")))

    return items.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def late_once(stream: DataFrame, key: str, event_time: str, delay: str = "1 hour") -> DataFrame:
    """Drops repeats of a key that arrive within ``delay`` of its event time."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])


def activity(stream: DataFrame, event_time: str, by: str, window: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Events of each kind in tumbling windows, late ones up to ``delay``."""
    return stream.withWatermark(event_time, delay).groupBy(F.window(event_time, window), by).agg(F.count("*").alias("n_events"))
