"""Connectors as a streaming data source: the offset is the connector's cursor, pages are partitions.

A connector lists (cursor, id) pairs of a stream (a mailbox, a channel, a database, a
folder) after one cursor and up to another, and fetches an item's content. The
streaming source asks each stream for its newest cursor, cuts what lies between the last
offset and the new one into pages, and fetches every page in a task of its own. An offset
names cursors only, so a restarted query lists and fetches exactly the range of the batch
it has to repeat. An item that cannot be fetched in ``tries`` attempts is a row with an
``error`` and no payload; it holds nothing up.

Clients are handed in: any object that can be pickled and has the calls that a
connector names. Credentials and transport are theirs.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from lodestone.sources import connectors

ITEM = "stream string, source_id string, cursor_after string, payload binary, error string"


def place(cursor: str) -> tuple:
    """Cursors as they compare: numbers by value, before all text."""
    try:
        return (0, float(cursor), "")
    except ValueError:
        return (1, 0.0, cursor)


def between(items: list[tuple[str, str]], since: str | None, until: str | None) -> list[tuple[str, str]]:
    """Items after ``since`` and up to ``until``, in order."""
    low, high = since and place(since), until and place(until)
    return sorted((i for i in items if (not low or place(i[0]) > low) and (not high or place(i[0]) <= high)), key=lambda i: (place(i[0]), i[1]))


class Connector:
    """What a source has to offer. Subclasses list with ``listing`` and fetch with ``fetch``."""

    def streams(self) -> list[str]:
        return ["main"]

    def listing(self, stream: str, since: str | None, until: str | None = None) -> list[tuple[str, str]]:
        """``(cursor, source_id)`` of the items after ``since`` up to ``until``; ids and cursors only, so they fit the driver."""
        raise NotImplementedError

    def fetch(self, stream: str, source_id: str) -> bytes:
        raise NotImplementedError

    def newest(self, stream: str, since: str | None) -> str | None:
        """The cursor of the newest item after ``since``, else ``since``."""
        found = between(self.listing(stream, since), since, None)
        return found[-1][0] if found else since

    def pages(self, stream: str, since: str | None, until: str | None, limit: int) -> list[tuple[str | None, str]]:
        """Ranges (after, up to) of some ``limit`` items each; items of one cursor are never parted."""
        found = between(self.listing(stream, since, until), since, until)
        ends = [found[i][0] for i in range(limit - 1, len(found), limit)] + ([found[-1][0]] if found else [])
        ranges, last = [], since
        for end in ends:
            if last is None or place(end) > place(last):
                ranges.append((last, end))
                last = end
        return ranges

    def healthy(self) -> bool:
        """Whether every stream can be listed."""
        try:
            for s in self.streams():
                self.newest(s, None)
            return True
        except Exception:  # noqa: BLE001  the answer is no, whatever the reason
            return False


class MailConnector(Connector):
    """Mailboxes by ranges of UIDs. ``client``: ``uids(mailbox, low, high)``, ``message(mailbox, uid) -> bytes``."""

    def __init__(self, client: Any, mailboxes: tuple[str, ...] = ("INBOX",)):
        self.client, self.mailboxes = client, mailboxes

    def streams(self):
        return list(self.mailboxes)

    def listing(self, stream, since, until=None):
        low = int(since) + 1 if since else 1
        # A server answers a range beyond its last UID with that UID, so the bounds are checked again.
        return [(str(u), str(u)) for u in self.client.uids(stream, low, until and int(until)) if u >= low]

    def fetch(self, stream, source_id):
        return self.client.message(stream, int(source_id))


class ChatConnector(Connector):
    """Roots of channels' threads by time. ``client``: ``history(channel, oldest, latest, cursor) -> {messages, next}`` and ``replies(channel, ts) -> [messages]``."""

    def __init__(self, client: Any, channels: tuple[str, ...]):
        self.client, self.channels = client, channels

    def streams(self):
        return list(self.channels)

    def listing(self, stream, since, until=None):
        found, cursor = [], None
        while True:
            page = self.client.history(stream, since, until, cursor)
            found += [(m["ts"], m["ts"]) for m in page["messages"] if m.get("thread_ts") in (None, m["ts"])]  # replies come with their root
            cursor = page.get("next")
            if not cursor:
                return found

    def fetch(self, stream, source_id):
        return json.dumps(self.client.replies(stream, source_id)).encode()


class NoteConnector(Connector):
    """Pages of note databases by time of edit. ``client``: ``query(database, after, cursor) -> {results, next_cursor}``, ``search(cursor)`` of that form for
    databases that cannot be queried, and ``children(page, cursor) -> {results, next_cursor}``."""

    def __init__(self, client: Any, databases: tuple[str, ...] = ("",)):
        self.client, self.databases = client, databases

    def streams(self):
        return list(self.databases)

    def _all(self, call) -> Iterator[dict]:
        cursor = None
        while True:
            page = call(cursor)
            yield from page["results"]
            cursor = page.get("next_cursor")
            if not cursor:
                return

    def listing(self, stream, since, until=None):
        try:
            rows = list(self._all(lambda c: self.client.query(stream, since, c))) if stream else None
        except Exception:  # noqa: BLE001  the search has the pages as well
            rows = None
        if rows is None:
            rows = [r for r in self._all(self.client.search) if not since or r["last_edited_time"] > since]
        return [(r["last_edited_time"], r["id"]) for r in rows]

    def fetch(self, stream, source_id):
        return json.dumps(list(self._all(lambda c: self.client.children(source_id, c)))).encode()


class DocumentConnector(Connector):
    """Documents of folders by time of change. ``client``: ``files(clause, page_token) -> {files, nextPageToken}`` and ``document(id) -> {paragraphs}``."""

    KIND = "mimeType = 'application/vnd.google-apps.document'"  # fixed value of the service

    def __init__(self, client: Any, folders: tuple[str, ...] = ()):
        self.client, self.folders = client, folders

    def clause(self, since: str | None) -> str:
        parts = [self.KIND, "trashed = false"]
        if self.folders:
            parts.append("(" + " or ".join(f"'{f}' in parents" for f in self.folders) + ")")
        return " and ".join([*parts, f"modifiedTime > '{since}'"] if since else parts)

    def listing(self, stream, since, until=None):
        found, token = [], None
        while True:
            page = self.client.files(self.clause(since), token)
            found += [(f["modifiedTime"], f["id"]) for f in page["files"]]
            token = page.get("nextPageToken")
            if not token:
                return found

    def fetch(self, stream, source_id):
        return json.dumps(self.client.document(source_id)["paragraphs"]).encode()


class _Range(InputPartition):
    def __init__(self, stream: str, since: str | None, until: str | None):
        self.stream, self.since, self.until = stream, since, until


class _Reading:
    """What the batch and the streaming reader share: options and the fetching of a page."""

    def __init__(self, connector: Connector, options: dict):
        self.connector = connector
        self.since = options.get("since") or None
        self.limit, self.tries = int(options.get("limit", "100")), int(options.get("tries", "3"))
        self.wait = float(options.get("wait", "0.5"))

    def ranges(self, stream: str, since: str | None, until: str | None) -> list[_Range]:
        return [_Range(stream, a, b) for a, b in self.connector.pages(stream, since, until, self.limit)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        for cursor, name in between(self.connector.listing(partition.stream, partition.since, partition.until), partition.since, partition.until):
            payload, error = None, None
            for n in range(self.tries):
                try:
                    payload, error = bytes(self.connector.fetch(partition.stream, name)), None
                    break
                except Exception as e:  # noqa: BLE001  it becomes the row's error
                    error = f"error/{type(e).__name__}"
                    time.sleep(self.wait * n)
            yield (partition.stream, name, cursor, payload, error)


class _Batch(_Reading, DataSourceReader):
    def partitions(self):
        return [r for s in self.connector.streams() for r in self.ranges(s, self.since, self.connector.newest(s, self.since))]


class _Stream(_Reading, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {s: self.since for s in self.connector.streams()}

    def latestOffset(self) -> dict:
        return {s: self.connector.newest(s, self.since) for s in self.connector.streams()}

    def partitions(self, start: dict, end: dict):
        return [r for s, until in end.items() if until is not None for r in self.ranges(s, start.get(s, self.since), until)]

    def commit(self, end: dict) -> None:
        """Nothing is held: the next batch begins at its offset."""


def register(spark: SparkSession, name: str, connector: Connector) -> None:
    """Makes ``spark.read.format(name)`` and ``spark.readStream.format(name)`` read a connector's items.

    Options: ``since`` (a cursor), ``limit`` (items a page), ``tries`` and ``wait`` (seconds more each time) of a fetch.
    """
    format_name = name

    class Source(DataSource):
        @classmethod
        def name(cls):
            return format_name

        def schema(self):
            return ITEM

        def reader(self, schema):
            return _Batch(connector, self.options)

        def streamReader(self, schema):
            return _Stream(connector, self.options)

    spark.dataSource.register(Source)


# Items as artifacts


def _artifact(items: DataFrame, kind: str, text: Column) -> DataFrame:
    return items.select(
        F.lit(kind).alias("source_type"), F.concat_ws(":", F.lit(kind), "stream", "source_id").alias("source_id"), text.alias("content_text"), F.lit("text/plain").alias("mime_type"), "cursor_after"
    )


def mail_items(items: DataFrame) -> DataFrame:
    return connectors.mail_artifacts(items.select(F.col("cursor_after").alias("uid"), F.col("payload").alias("raw")))


def chat_items(items: DataFrame) -> DataFrame:
    rows = F.from_json(F.decode("payload", "UTF-8"), "array<struct<ts:string,user:string,text:string>>")
    line = lambda m: F.concat(F.lit("["), m["ts"], F.lit("] <"), F.coalesce(m["user"], F.lit("unknown")), F.lit(">: "), F.coalesce(m["text"], F.lit("")))
    return _artifact(items, "slack", F.array_join(F.transform(F.array_sort(rows), line), "\n"))


def note_items(items: DataFrame) -> DataFrame:
    return _artifact(items, "notion", connectors.note_text(F.from_json(F.decode("payload", "UTF-8"), "array<struct<type:string,text:string,checked:boolean>>")))


def document_items(items: DataFrame) -> DataFrame:
    return _artifact(items, "gdocs", connectors.document_text(F.from_json(F.decode("payload", "UTF-8"), "array<struct<style:string,runs:array<string>,rows:array<array<string>>>>")))
