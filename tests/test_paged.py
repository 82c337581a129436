"""Connectors as streams: one replayed fixture for mail, chat, notes and documents."""

import json
import sys

import pytest
from pyspark import cloudpickle

from lodestone.operators.store import Store
from lodestone.plans.engine import Engine
from lodestone.sources import paged
from lodestone.streaming import incremental

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import tests


class Client:
    """Answers from a JSON file, so a test can add items between runs; ``broken`` ids fail."""

    def __init__(self, path):
        self.path = str(path)

    def data(self):
        with open(self.path) as f:
            return json.load(f)

    def _part(self, rows, cursor, size=2):
        start = int(cursor or 0)
        more = start + size < len(rows)
        return rows[start : start + size], (str(start + size) if more else None)

    # mail
    def uids(self, mailbox, low, high):
        found = [int(u) for u in self.data()["mail"]]
        inside = [u for u in found if u >= low and (high is None or u <= high)]
        return inside or found[-1:]  # as a server does

    def message(self, mailbox, uid):
        if uid in self.data()["broken"]:
            raise OSError("gone")
        return self.data()["mail"][str(uid)].encode()

    # chat: newest first, oldest excluded
    def history(self, channel, oldest, latest, cursor):
        rows = [m for m in self.data()["chat"][channel] if (not oldest or m["ts"] > oldest) and (not latest or m["ts"] <= latest)]
        part, after = self._part(sorted(rows, key=lambda m: m["ts"], reverse=True), cursor)
        return {"messages": part, "next": after}

    def replies(self, channel, ts):
        return [m for m in self.data()["chat"][channel] if m.get("thread_ts", m["ts"]) == ts]

    # notes
    def query(self, database, after, cursor):
        if database == "closed":
            raise PermissionError
        rows = [n for n in self.data()["notes"] if not after or n["last_edited_time"] > after]
        part, nxt = self._part(rows, cursor)
        return {"results": part, "next_cursor": nxt}

    def search(self, cursor):
        part, nxt = self._part(self.data()["notes"], cursor)
        return {"results": part, "next_cursor": nxt}

    def children(self, page, cursor):
        part, nxt = self._part(next(n for n in self.data()["notes"] if n["id"] == page)["blocks"], cursor, 1)
        return {"results": part, "next_cursor": nxt}

    # documents
    def files(self, clause, token):
        after = clause.partition("modifiedTime > '")[2].rstrip("'")
        rows = [d for d in self.data()["documents"] if d["modifiedTime"] > after and f"'{d['folder']}' in parents" in clause]
        part, nxt = self._part(rows, token)
        return {"files": part, "nextPageToken": nxt}

    def document(self, name):
        return next(d for d in self.data()["documents"] if d["id"] == name)


def fixture(n):
    chat = [{"ts": f"{100 + i}.5", "user": "u", "text": f"root {i}."} for i in range(n)] + [{"ts": "900.1", "thread_ts": "101.5", "text": "a reply."}]
    return {
        "mail": {str(u): f"Message-ID: <m{u}@x>\nSubject: Mail {u}\nContent-Type: text/plain\n\nBody of mail {u}." for u in range(8, 8 + n)},
        "chat": {"general": chat, "other": [{"ts": "7.0", "text": "elsewhere."}]},
        "notes": [{"id": f"n{i}", "last_edited_time": f"2024-01-{10 + i // 3:02d}T00:00:00Z", "blocks": [{"type": "heading_1", "text": f"Note {i}"}, {"type": "paragraph", "text": f"text of note {i}."}]} for i in range(n)],
        "documents": [{"id": f"d{i}", "folder": "f1" if i % 2 else "f2", "modifiedTime": f"2024-02-{10 + i:02d}", "paragraphs": [{"style": "HEADING_1", "runs": [f"Doc {i}"]}, {"rows": [["a", "b"]]}]} for i in range(n)],
        "broken": [9],
    }


CASES = [
    ("mail", lambda c: paged.MailConnector(c), paged.mail_items, lambda n: n),
    ("chat", lambda c: paged.ChatConnector(c, ("general", "other")), paged.chat_items, lambda n: n + 1),
    ("notes", lambda c: paged.NoteConnector(c, ("db",)), paged.note_items, lambda n: n),
    ("closed", lambda c: paged.NoteConnector(c, ("closed",)), paged.note_items, lambda n: n),
    ("documents", lambda c: paged.DocumentConnector(c, ("f1", "f3")), paged.document_items, lambda n: n // 2),
]


@pytest.mark.parametrize(("name", "make", "convert", "count"), CASES)
def test_pages_of_a_backlog_and_restart(spark, tmp_path, name, make, convert, count):
    """A first run over several pages, a run without news, and one after news: every item once, none lost."""
    path = tmp_path / "data.json"
    path.write_text(json.dumps(fixture(6)))
    connector = make(Client(path))
    paged.register(spark, f"paged_{name}", connector)
    batch = spark.read.format(f"paged_{name}").option("limit", 2).option("wait", 0).load()
    assert batch.count() == count(6) and batch.rdd.getNumPartitions() >= count(6) // 3 and connector.healthy()
    seen = []

    def run():
        stream = spark.readStream.format(f"paged_{name}").option("limit", 2).option("wait", 0).load()
        q = stream.writeStream.foreachBatch(lambda df, i: seen.extend((r["stream"], r["source_id"], r["error"]) for r in df.collect()))
        q.option("checkpointLocation", f"file://{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination(60)

    run()
    assert len(seen) == len(set(seen)) == count(6)
    run()
    assert len(seen) == count(6)
    path.write_text(json.dumps(fixture(12)))
    run()
    assert len(seen) == len(set(seen)) == count(12)
    assert [s[1] for s in seen if s[2]] == (["9"] if name == "mail" else [])
    texts = {r["source_id"]: r["content_text"] for r in convert(batch.where("error IS NULL")).collect()}
    expected = {"mail": ("email:<m8@x>", "Subject: Mail 8\n\nBody of mail 8."), "chat": ("slack:general:101.5", "[101.5] <u>: root 1.\n[900.1] <unknown>: a reply."), "documents": ("gdocs:main:d1", "# Doc 1\n| a | b |")}
    key, text = expected.get(name, (f"notion:{'db' if name == 'notes' else 'closed'}:n2", "# Note 2\ntext of note 2."))
    assert texts[key] == text


def test_since_limit_and_ties():
    class Ties(paged.Connector):
        def listing(self, stream, since, until=None):
            return [("1", "a"), ("2", "b"), ("2", "c"), ("2", "d"), ("3", "e"), ("10", "f")]

    c = Ties()
    assert c.pages("main", None, "10", 2) == [(None, "2"), ("2", "3"), ("3", "10")] or c.pages("main", None, "10", 2) == [(None, "2"), ("2", "10")]
    ranges = c.pages("main", "1", "3", 1)
    assert [i for a, b in ranges for i in paged.between(c.listing("main", None), a, b)] == [("2", "b"), ("2", "c"), ("2", "d"), ("3", "e")]
    assert c.newest("main", "3") == "10" and c.newest("main", "10") == "10"
    assert not paged.Connector().healthy()


def test_stream_into_the_store(spark, tmp_path):
    path = tmp_path / "data.json"
    path.write_text(json.dumps(fixture(3)))
    paged.register(spark, "paged_store", paged.MailConnector(Client(path)))
    engine = Engine(spark, Store(spark, f"file://{tmp_path}/store"), token_budget=64)
    for _ in range(2):
        items = spark.readStream.format("paged_store").option("limit", 1).option("wait", 0).load()
        incremental.sync_stream(engine, "mail", items, paged.mail_items, f"file://{tmp_path}/ck").awaitTermination(120)
    assert engine.store.read("documents").count() == 2
    assert [(r["source_id"], r["reason"]) for r in engine.store.read("dead_letters").collect()] == [("9", "error/OSError")]
