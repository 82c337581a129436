"""Document store: keyed tables in hashed buckets, written as segments and committed by one manifest for all tables.

A table's rows lie in buckets by a hash of the first column of their key. A save
writes one new segment that holds just the saved rows, in the buckets they fall
into; a removal writes a segment of keys. Readers put segments together: in buckets
that later segments touch, the latest row of a key counts, all other buckets are
plain scans. When a table has too many segments, the buckets that have several are
compacted into one.

A commit adds the next numbered manifest, a small JSON file that lists every table's
segments, and succeeds only if no other writer has added that number; a writer that
loses applies its change to the winner's manifest and tries again, so both survive. A
reader takes one manifest, so it sees all tables as of one commit. Files are never
overwritten; what only manifests older than the last ``keep`` name is removed.
"""

from __future__ import annotations

import json
import uuid
from collections import Counter
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

KEYS = {
    "documents": ["doc_id"],
    "blocks": ["doc_id", "sequence"],
    "chunks": ["doc_id", "chunk_id"],
    "places": ["chunk_id", "doc_id"],
    "vectors": ["chunk_id"],
    "forward": ["chunk_id"],
    "gone": ["chunk_id"],
    "connector_state": ["connector_name"],
    "dead_letters": ["connector_name", "source_id"],
}
#: Tables of rows that add up, by the column that they are dealt by.
ADDED = {"terms": "term", "blocks_of_terms": "term", "corpus": "chunks", "runs": "run_id", "answers": "run_id"}
_BUCKET, _PLACE = "__bucket", "__segment"


class Conflict(RuntimeError):
    """A commit that others kept overtaking, or whose ground is gone."""


@dataclass
class Segment:
    """Rows (or keys to remove) written but not yet part of a manifest."""

    table: str
    entry: dict
    rows: DataFrame


class Snapshot:
    """All tables as of one manifest."""

    def __init__(self, store: Store, number: int, tables: dict):
        self.store, self.number, self.tables = store, number, tables

    def exists(self, name: str) -> bool:
        return name in self.tables

    def files(self, name: str, entry: dict, buckets: Iterable[int] | None = None) -> DataFrame:
        """Rows of a segment, of some of its buckets."""
        return self.store._rows(name, entry, self.tables[name]["shape"] if entry["kind"] == "rows" else entry["shape"], buckets)

    def read(self, name: str, buckets: set[int] | None = None) -> DataFrame | None:
        """A table's current rows, of some of its buckets; None if there is no such table."""
        if name not in self.tables:
            return None
        table = self.tables[name]
        segments = [s for s in table["segments"] if buckets is None or buckets & set(s["buckets"])]
        key = table["key"]
        plain, merged, later = [], [], []
        for i, s in enumerate(segments):
            own = set(s["buckets"]) if buckets is None else buckets & set(s["buckets"])
            touched = own & {b for t in segments[i + 1 :] for b in t["buckets"]} if key else set()
            if s["kind"] == "rows":
                if own - touched:
                    plain.append(self.files(name, s, own - touched))
                if touched:
                    merged.append(self.files(name, s, touched).withColumn(_PLACE, F.lit(i)))
            if i and key:
                later.append((s["kind"], i, self.files(name, s, own)))
        parts = list(plain)
        if merged:
            rows = merged[0]
            for more in merged[1:]:
                rows = rows.unionByName(more)
            for kind, columns in (("rows", key), ("gone", key[:1])):
                over = [d.select(*columns, F.lit(i).alias("__over")) for k, i, d in later if k == kind]
                if over:
                    latest = over[0]
                    for more in over[1:]:
                        latest = latest.unionByName(more)
                    latest = latest.groupBy(*columns).agg(F.max("__over").alias("__over")).select(*[F.col(c).alias(f"__{c}") for c in columns], "__over")
                    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in columns]
                    rows = rows.join(latest, same, "left").where(F.col("__over").isNull() | (F.col("__over") <= F.col(_PLACE))).drop("__over", *[f"__{c}" for c in columns])
            parts.append(rows.drop(_PLACE))
        if not parts:
            return self.store.spark.createDataFrame([], table["shape"])
        out = parts[0]
        for more in parts[1:]:
            out = out.unionByName(more)
        return out

    def sound(self, name: str) -> bool:
        """Whether a table's files are there, with readable footers that count the rows once written; a table never written is sound."""
        try:
            held = [(s, self.files(name, s).count()) for s in self.tables.get(name, {"segments": []})["segments"]]
        except (PySparkException, Py4JJavaError):
            return False
        return all(s.get("rows") in (None, n) for s, n in held)

    def of(self, name: str, keys: DataFrame) -> DataFrame | None:
        """Rows of the given documents (or other first keys), ordered by the table's key; only their buckets are read."""
        if name not in self.tables:
            return None
        table = self.tables[name]
        first = table["key"][0]
        wanted = keys.select(first).where(F.col(first).isNotNull()).distinct()
        buckets = {r[0] for r in wanted.select(_bucket(first, table["n"]).alias("b")).distinct().collect()}  # at most as many as buckets
        return self.read(name, buckets).join(wanted, first, "left_semi").orderBy(*table["key"])

    def lookup(self, name: str, values: list) -> DataFrame | None:
        """Rows whose first key is one of a few ``values``: their buckets only, and of these the row groups whose Bloom filter may hold one."""
        if name not in self.tables:
            return None
        table = self.tables[name]
        first = table["key"][0]
        kind = self.read(name, set()).schema[first].dataType
        held = self.store.spark.createDataFrame([(v,) for v in values], f"v {kind.simpleString()}")
        buckets = {r[0] for r in held.select(_bucket("v", table["n"]).alias("b")).distinct().collect()}
        return self.read(name, buckets).where(F.col(first).isin(values))


def _bucket(column: str, n: int):
    return F.pmod(F.xxhash64(F.col(column).cast("string")), F.lit(n)).cast("int")


class Store:
    def __init__(self, spark: SparkSession, path: str, keep: int = 6, buckets: int = 16, segments: int = 8, tries: int = 20):
        """``buckets`` of a new table (size it so that one holds some 100 MB), ``segments`` before compaction."""
        self.spark, self.path, self.keep, self.buckets, self.segments, self.tries = spark, path.rstrip("/"), keep, buckets, segments, tries
        self.merges: dict[str, Callable[[DataFrame], DataFrame]] = {}

    # Files

    def _folder(self, path: str):
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return folder, folder.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _add(self, path: str, text: str) -> bool:
        """A file with ``text``, whole, unless there is one of that name."""
        jvm = self.spark._jvm
        target, fs = self._folder(path)
        if fs.exists(target):
            return False
        draft, _ = self._folder(f"{path}.{uuid.uuid4().hex}.draft")
        out = fs.create(draft, False)
        out.write(bytearray(text.encode()))
        out.close()
        try:
            if fs.getScheme() == "file":  # a rename would overwrite here, a link does not
                name = lambda p: jvm.java.io.File(p.toUri().getPath()).toPath()
                jvm.java.nio.file.Files.createLink(name(target), name(draft))
            else:
                none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration()).rename(draft, target, none)
            return True
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                return False
            raise
        finally:
            fs.delete(draft, False)

    def _text(self, path: str) -> str:
        folder, fs = self._folder(path)
        stream = fs.open(folder)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _numbers(self) -> list[int]:
        folder, fs = self._folder(f"{self.path}/_manifests")
        if not fs.exists(folder):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def _manifest(self, number: int) -> str:
        return f"{self.path}/_manifests/{number:012d}.json"

    def _rows(self, name: str, entry: dict, shape: str, buckets: Iterable[int] | None = None) -> DataFrame:
        held = sorted(entry["buckets"] if buckets is None else set(entry["buckets"]) & set(buckets))
        if not held:
            return self.spark.createDataFrame([], shape)
        folder = f"{self.path}/{entry.get('folder', name + '/' + entry['id'])}"
        # A compacted segment keeps its files but names fewer buckets, so the named ones are read.
        reader = self.spark.read.schema(f"{shape}, `{_BUCKET}` int").option("basePath", folder)
        return reader.parquet(*[f"{folder}/{_BUCKET}={b}" for b in held]).drop(_BUCKET)

    # Reading

    def snapshot(self, back: int = 0) -> Snapshot:
        """All tables as of the latest commit, or as of one some commits ``back`` among those kept."""
        held = self._numbers()
        held = held[: max(0, len(held) - back)]
        return Snapshot(self, held[-1], json.loads(self._text(self._manifest(held[-1])))) if held else Snapshot(self, -1, {})

    def exists(self, name: str) -> bool:
        return self.snapshot().exists(name)

    def read(self, name: str) -> DataFrame | None:
        """The current rows of a table; None before its first write."""
        return self.snapshot().read(name)

    def of(self, name: str, doc_ids: DataFrame) -> DataFrame | None:
        return self.snapshot().of(name, doc_ids)

    def latest_first(self) -> DataFrame | None:
        """Documents, newest first."""
        held = self.read("documents")
        if held is None:
            return None
        return held.orderBy(*([F.desc("ingested_at")] if "ingested_at" in held.columns else []), "source_path", "doc_id")

    # Writing

    def _key(self, name: str) -> list[str]:
        return [] if name in ADDED else KEYS.get(name, ["doc_id"])

    def _write(self, name: str, rows: DataFrame, first: str, n: int, kind: str) -> Segment:
        shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
        entry = {"id": uuid.uuid4().hex, "kind": kind, "shape": shape, "n": n}
        folder = f"{self.path}/{name}/{entry['id']}"
        dealt = rows.withColumn(_BUCKET, _bucket(first, n)).hint("rebalance", _BUCKET)  # a bucket of any size is split over tasks
        seen = Observation()
        writer = dealt.sortWithinPartitions(_BUCKET, first).observe(seen, F.count(F.lit(1)).alias("n")).write.partitionBy(_BUCKET)
        writer.option(f"parquet.bloom.filter.enabled#{first}", "true").parquet(folder)
        entry["rows"] = seen.get["n"]
        path, fs = self._folder(folder)
        parts = [f.getPath().getName() for f in fs.listStatus(path)]
        entry["buckets"] = sorted(int(p.partition("=")[2]) for p in parts if p.startswith(f"{_BUCKET}="))
        return Segment(name, entry, self._rows(name, entry, shape))

    def stage(self, name: str, rows: DataFrame, distinct: bool = False, **more: Column) -> Segment:
        """Writes rows, with ``more`` columns, as a segment that no reader sees before its commit; ``.rows`` reads it back.

        ``distinct`` rows are known to repeat no key.
        """
        rows = rows.withColumns(more) if more else rows
        table = self.snapshot().tables.get(name)
        if table is not None:
            rows = rows.select(self.spark.createDataFrame([], table["shape"]).columns)
        key = self._key(name)
        return self._write(name, rows.dropDuplicates(key) if key and not distinct else rows, key[0] if key else ADDED[name], table["n"] if table else self.buckets, "rows")

    def stage_removal(self, name: str, keys: DataFrame) -> Segment:
        """Writes the first keys of rows to be removed."""
        table = self.snapshot().tables.get(name)
        first = self._key(name)[0]
        return self._write(name, keys.select(first).distinct(), first, table["n"] if table else self.buckets, "gone")

    def stage_removals(self, names: list[str], keys: DataFrame) -> list[Segment]:
        """Removals of the same first keys from several tables, written once each where the tables' buckets differ."""
        done: dict[int, Segment] = {}
        out = []
        for name in names:
            n = self.snapshot().tables.get(name, {"n": self.buckets})["n"]
            if n not in done:
                done[n] = self.stage_removal(name, keys)
            first = done[n]
            out.append(Segment(name, first.entry | {"folder": f"{first.table}/{first.entry['id']}"}, first.rows))
        return out

    def _commit(self, change: Callable[[dict], dict]) -> int:
        for _ in range(self.tries):
            held = self.snapshot()
            if self._add(self._manifest(held.number + 1), json.dumps(change(json.loads(json.dumps(held.tables))))):
                self._clean()
                return held.number + 1
        raise Conflict(f"no manifest could be added in {self.tries} tries")

    def commit(self, segments: list[Segment], replaced: Iterable[str] = (), since: Snapshot | None = None) -> None:
        """Makes staged segments visible together; of tables in ``replaced`` nothing older stays.

        What was made from a whole snapshot names it as ``since``: a commit in between is a conflict then.
        """

        def change(tables: dict) -> dict:
            if since is not None and tables != since.tables:
                raise Conflict("the store has changed meanwhile")
            for name in replaced:
                tables.pop(name, None)
            for s in segments:
                if s.entry["kind"] == "rows":
                    tables.setdefault(s.table, {"shape": s.entry["shape"], "key": self._key(s.table), "n": s.entry["n"], "segments": []})
                if s.table in tables and s.entry["buckets"]:
                    tables[s.table]["segments"].append(s.entry)
            return tables

        self._commit(change)
        held = self.snapshot()
        for name in {s.table for s in segments} & set(held.tables):
            of_bucket = Counter(b for s in held.tables[name]["segments"] for b in s["buckets"])
            if max(of_bucket.values(), default=0) > self.segments or len(held.tables[name]["segments"]) > self.segments * self.segments:
                try:
                    self.compact(name)
                except Conflict:  # another writer is at it
                    pass

    def replace(self, name: str, rows: DataFrame) -> None:
        key = self._key(name)
        first = key[0] if key else ADDED[name]
        self.commit([self._write(name, rows.dropDuplicates(key) if key else rows, first, self.buckets, "rows")], [name])

    def save(self, name: str, rows: DataFrame) -> None:
        """Puts rows in place of those with the same key."""
        self.commit([self.stage(name, rows)])

    def delete(self, doc_ids: DataFrame) -> None:
        """Removes documents with their blocks and chunks, in one commit."""
        held = self.snapshot()
        self.commit([self.stage_removal(name, doc_ids) for name in ("documents", "blocks", "chunks") if held.exists(name)])

    def compact(self, name: str) -> None:
        """Writes the buckets that several segments share anew, as one; rows that add up are summed on the way, where ``merges`` says how."""
        held = self.snapshot()
        table = held.tables[name]
        counts = Counter(b for s in table["segments"] for b in s["buckets"])
        shared = set(counts) if len(table["segments"]) > self.segments * self.segments else {b for b, n in counts.items() if n > 1}
        if not shared:
            return
        rows = held.read(name, shared)
        made = self._write(name, self.merges.get(name, lambda r: r)(rows), table["key"][0] if table["key"] else ADDED[name], table["n"], "rows")
        before = [s["id"] for s in table["segments"]]

        def change(tables: dict) -> dict:
            now = tables.get(name, {"segments": []})
            if [s["id"] for s in now["segments"][: len(before)]] != before:
                raise Conflict(f"{name} was compacted or replaced meanwhile")
            old = [s if shared.isdisjoint(s["buckets"]) else s | {"buckets": sorted(set(s["buckets"]) - shared), "rows": None} for s in now["segments"][: len(before)]]
            now["segments"] = [s for s in old if s["buckets"]] + ([made.entry] if made.entry["buckets"] else []) + now["segments"][len(before) :]
            return tables

        self._commit(change)

    def _clean(self) -> None:
        """Removes manifests before the last ``keep``, and segments that only they name; what is not yet committed stays."""
        numbers = self._numbers()
        old, kept = numbers[: -self.keep], numbers[-self.keep :]
        if not old:
            return
        named = lambda n: {s.get("folder", f"{name}/{s['id']}") for name, t in json.loads(self._text(self._manifest(n))).items() for s in t["segments"]}
        live = set().union(*[named(n) for n in kept])
        for n in old:
            for segment in named(n) - live:
                folder, fs = self._folder(f"{self.path}/{segment}")
                fs.delete(folder, True)
            path, fs = self._folder(self._manifest(n))
            fs.delete(path, False)

    def cursor(self, connector: str) -> str | None:
        held = self.snapshot().lookup("connector_state", [connector])
        row = held.first() if held is not None else None
        return row["cursor"] if row else None
