"""Message threads and incremental sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def flatten(messages: DataFrame, thread: str, order: str, author: str, text: str) -> DataFrame:
    """``thread, n_messages, cursor, text``: a thread's messages as ``[order] <author>: text`` lines in order; the cursor is the last."""
    line = F.concat(F.lit("["), F.col(order).cast("string"), F.lit("] <"), F.coalesce(F.col(author), F.lit("unknown")), F.lit(">: "), F.coalesce(F.col(text), F.lit("")))
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), line.alias("line"))))
    return messages.groupBy(thread).agg(F.count("*").alias("n_messages"), F.max(order).alias("cursor"), F.array_join(rows["line"], "\n").alias("text"))


def ordered(cursor: Column) -> Column:
    """Cursors as they compare: numbers by value (10 after 9), before all text, which compares as text."""
    number = cursor.cast("string").try_cast("decimal(38,9)")
    return F.struct(number.isNull().alias("is_text"), F.coalesce(number, F.lit(0)).alias("number"), F.when(number.isNull(), cursor.cast("string")).alias("text"))


def since(items: DataFrame, order: str, cursor) -> DataFrame:
    """Items after the cursor; all of them where it is None."""
    return items if cursor is None else items.where(F.col(order) > F.lit(cursor))


def next_cursor(items: DataFrame, order: str) -> DataFrame:
    return items.agg(F.max(order).alias("cursor"))


def sync_counters(fetched: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """``fetched, ingested, skipped, failed``: known items are skipped, items without text fail."""
    marked = fetched.join(known.select(key).distinct().withColumn("known", F.lit(True)), key, "left")
    empty = F.coalesce(F.trim("text"), F.lit("")) == ""
    old = F.coalesce("known", F.lit(False))
    return marked.agg(
        F.count("*").alias("fetched"), F.count_if(~old & ~empty).alias("ingested"), F.count_if(old).alias("skipped"), F.count_if(~old & empty).alias("failed")
    )
