"""External items as rows: mail, chat threads, pages of note and document services.

Fetching is left to a reader that the caller registers as a Python data source
or lands as files; these functions turn what it fetched into artifacts
``source_type, source_id, content_text, content_bytes, mime_type, cursor_after``.
"""

from __future__ import annotations

import email
import email.policy
import hashlib
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lodestone.functions import text as T

ARTIFACT = "source_type string, source_id string, external_url string, content_text string, content_bytes binary, mime_type string, cursor_after string"
MAX_ATTACHMENT = 5 << 20


def _mail(uid: str, raw: bytes) -> Iterator[tuple]:
    message = email.message_from_bytes(raw, policy=email.policy.default)
    name = message.get("Message-ID")
    source = f"email:{name.strip()}" if name else "email:" + hashlib.sha256(uid.encode()).hexdigest()[:16]
    plain, html, files = [], [], []
    for part in message.walk():
        if part.is_multipart():
            continue
        body = part.get_payload(decode=True) or b""
        if part.get_content_type() == "application/pdf" or part.get_filename():
            if part.get_content_type() == "application/pdf":
                files.append((part.get_filename() or "attachment.pdf", body))
        elif part.get_content_type() == "text/plain":
            plain.append(body.decode(part.get_content_charset() or "utf-8", "replace").strip())
        elif part.get_content_type() == "text/html":
            html.append(re.sub(r"<[^>]*>?", "", body.decode(part.get_content_charset() or "utf-8", "replace")).strip())
    head = "\n".join(f"{k}: {message[k]}" for k in ("Subject", "From", "Date") if message[k])
    text = "\n\n".join([head, *(plain or html)]).strip()
    yield ("email", source, None, text, None, "text/plain", uid)
    for filename, body in files:
        kind = "application/pdf" if len(body) <= MAX_ATTACHMENT else "error/too-large"
        yield ("email", f"{source}/attachment/{filename}", None, None, body if kind == "application/pdf" else None, kind, uid)


def mail_artifacts(messages: DataFrame) -> DataFrame:
    """Artifacts of RFC 2822 messages (``uid``, ``raw``): the text, and each PDF.

    What cannot be used is a row without content whose ``mime_type`` says why: ``error/<kind>``
    for a broken message, ``error/too-large`` for a PDF of over 5 MB.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for uid, raw in batch.itertuples(index=False):
                try:
                    rows += list(_mail(str(uid), bytes(raw)))
                except Exception as e:  # noqa: BLE001  one broken message must not stop the others
                    rows.append(("email", f"email:uid:{uid}", None, None, None, f"error/{type(e).__name__}", str(uid)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in ARTIFACT.split(", ")])

    return messages.select(F.col("uid").cast("string"), "raw").mapInPandas(run, ARTIFACT)


def chat_artifacts(messages: DataFrame) -> DataFrame:
    """One artifact a thread from ``channel, ts, thread_ts, user, text``: root and replies in order, the cursor the largest ``ts``."""
    root = F.coalesce("thread_ts", "ts")
    line = F.concat(F.lit("["), F.col("ts"), F.lit("] <"), F.coalesce("user", F.lit("unknown")), F.lit(">: "), F.coalesce("text", F.lit("")))
    rows = F.array_sort(F.collect_list(F.struct("ts", line.alias("line"))))
    threads = messages.dropDuplicates(["channel", "ts"]).groupBy("channel", root.alias("root")).agg(rows.alias("rows"), F.max("ts").alias("cursor_after"))
    return threads.select(
        F.lit("slack").alias("source_type"),
        F.concat_ws(":", F.lit("slack"), "channel", "root").alias("source_id"),
        F.array_join("rows.line", "\n").alias("content_text"),
        F.lit("text/plain").alias("mime_type"),
        "cursor_after",
    )


def note_text(blocks: Column) -> Column:
    """Text of note blocks ``array<struct<type, text, checked>>``: the mark of each type before its text, unknown types left out."""
    t = lambda b: b["text"]
    marks = {"heading_1": "# ", "heading_2": "## ", "heading_3": "### ", "bulleted_list_item": "- ", "numbered_list_item": "1. ", "quote": "> "}

    def line(b: Column) -> Column:
        kind = b["type"]
        out = F.when(kind.isin("paragraph", "callout", "toggle"), t(b))
        for name, mark in marks.items():
            out = out.when(kind == name, F.concat(F.lit(mark), t(b)))
        out = out.when(kind == "to_do", F.concat(F.when(b["checked"], F.lit("[x] ")).otherwise("[ ] "), t(b)))
        out = out.when(kind == "code", F.concat(F.lit("```\n"), t(b), F.lit("\n```")))
        return out.when(kind == "child_page", F.concat(F.lit("[Page: "), t(b), F.lit("]")))

    return F.array_join(F.filter(F.transform(blocks, line), lambda x: x.isNotNull() & (x != "")), "\n")


def document_text(paragraphs: Column) -> Column:
    """Text of document parts ``array<struct<style, runs, rows>>``: headings by style, table rows as ``| a | b |``."""

    def line(p: Column) -> Column:
        level = F.regexp_extract(p["style"], "^HEADING_([1-6])$", 1)
        mark = F.when(level != "", F.concat(F.repeat(F.lit("#"), level.try_cast("int")), F.lit(" "))).when(p["style"] == "TITLE", "# ").otherwise("")
        table = F.array_join(F.transform(p["rows"], lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))), "\n")
        body = T.strip(F.array_join(p["runs"], ""))
        return F.when(F.coalesce(F.size(p["rows"]), F.lit(0)) > 0, table).otherwise(F.when(body != "", F.concat(mark, body)))

    return F.array_join(F.filter(F.transform(paragraphs, line), lambda x: x.isNotNull()), "\n")


class ListedSource(DataSource):
    """A batch data source over a listing function, one partition a listed page.

    Options: ``pages`` (number of pages). Subclasses give ``name``, ``schema``
    and :meth:`page`.
    """

    def page(self, number: int) -> Iterator[tuple]:
        raise NotImplementedError

    def reader(self, schema):
        return _ListedReader(self, int(self.options.get("pages", "1")))


class _ListedReader(DataSourceReader):
    def __init__(self, source: ListedSource, pages: int):
        self.source, self.pages = source, pages

    def partitions(self):
        return [InputPartition(n) for n in range(self.pages)]

    def read(self, partition):
        yield from self.source.page(partition.value)


def register_listing(spark: SparkSession, name: str, schema: str, page: Callable[[int], Iterator[tuple]]) -> None:
    """Makes ``spark.read.format(name)`` read the pages of a connector's listing."""
    shape = schema

    class Listing(ListedSource):
        @classmethod
        def name(cls):
            return name_

        def schema(self):
            return shape

        def page(self, number: int):
            return page(number)

    name_ = name
    spark.dataSource.register(Listing)
