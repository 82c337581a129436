"""Removal of repeated passages by bucket-pointer refinement of suffixes.

A byte goes if a ``width``-byte string that covers it also starts in a document
with a smaller id. Sorting every suffix of a corpus would move each byte many
times, so suffixes are bucketed and only buckets that stay mixed are refined:

1. Documents are written once as batches (one row each, compressed).
2. In each batch, every window of ``width`` bytes belongs to the smallest hash of
   the q-grams inside it, which depends on the window alone. Windows next to each
   other with the same smallest q-gram form a run. A run is sent on as two
   hashes (40 bits of its q-gram, 64 of its whole string) with the smallest id that
   holds it, once a batch.
3. All runs of a q-gram meet in one bucket. If they are one and the same string,
   the bucket is settled: its first document is known. Otherwise one batch is
   asked for the string of each distinct run. Questions and answers name a run by
   its place among those its batch sent to the shard, which the batch finds again.
4. In mixed buckets all suffixes of those strings get their initial q-gram
   buckets; sorting on the bucket identifiers of later offsets (8, 16, then 18
   bytes on) refines them, each round reusing the last round's identifiers,
   until they stand for whole windows. The smallest id in a bucket is the first
   document of its windows.
5. Batches get the answers for their runs, mark and cut the covered bytes.

A q-gram with very many distinct runs (a frequent phrase between ever new
neighbours) would make one bucket grow with the corpus. Such q-grams are found on
a sample, and each of their windows is a run of its own, dealt by a hash of the
whole window and told by two hashes of it (104 bits), so it is settled without its
string. The sample decides only how work is dealt, not the result.

A group of copies costs a row for each batch, not for each document, and no
window string is sent for text that occurs once.

Defined results: a null text counts as empty. Texts shorter than ``width`` lose
nothing. Rows with one id do not remove from each other; a null id counts as the
largest. Bytes may go inside a character: ``kept`` text then drops its rest.
All columns of the input are kept; columns named like a result are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import cut

GRAM = 20
LAST_ID = np.iinfo(np.int64).max
LOW40 = np.uint64((1 << 40) - 1)
_RNG = np.random.default_rng(20)
_BYTE_HASH = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_BASE, n, 1 << 64))


def _join(left: np.ndarray, right: np.ndarray, n_right: int, gap: int) -> np.ndarray:
    """Hashes of strings made of ``left`` at a place and ``right`` of ``n_right`` bytes, ``gap`` bytes on."""
    n = len(right) - gap
    return left[:n] * _power(n_right) + right[gap : gap + n]


def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """Smallest (or largest) of every ``width`` neighbours."""
    done, out = 1, x
    while done < width:
        step = min(done, width - done)
        out = pick(out[:-step], out[step:])
        done += step
    return out


def runs(data: np.ndarray, ends: np.ndarray, width: int, hot: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of all windows in joined texts that end at ``ends``: q-gram hash (40 bits), string hash (64), first window, windows.

    Windows of the q-grams in ``hot`` (sorted) are runs of their own, named by two hashes of the window.
    """
    none = np.zeros(0, np.uint64)
    if len(data) < width:
        return none, none, none.astype(np.int64), none.astype(np.int64)
    h1 = _BYTE_HASH[data]
    h2 = _join(h1, h1, 1, 1)
    h4 = _join(h2, h2, 2, 2)
    h8 = _join(h4, h4, 4, 4)
    h16 = _join(h8, h8, 8, 8)
    gram = _mix(_join(h16, h4, 4, 16))
    h32 = _join(h16, h16, 16, 16)
    whole = _join(_join(h32, h16, 16, 32), h2, 2, 48) if width == 50 else _window_hash(h1, width)
    least = _slide(gram, width - GRAM + 1, np.minimum)
    n = len(least)
    inside = np.zeros(n + 1, np.int32)  # windows that cross the end of a text
    np.add.at(inside, np.clip(ends - width + 1, 0, n), 1)
    np.add.at(inside, np.clip(ends, 0, n), -1)
    bad = np.cumsum(inside)[:n] > 0
    starts_text = np.zeros(n, bool)
    at = ends[ends < n]
    starts_text[at] = True
    new = starts_text
    new[0] = True
    new[1:] |= (least[1:] != least[:-1]) | (bad[1:] != bad[:-1])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, n))
    keep = ~bad[first]
    first, size = first[keep], size[keep]
    most = np.full(len(first), width - GRAM + 1)  # longer ones (of periodic text) are cut, so that two windows tell a run
    frequent = _among(least[first] & LOW40, hot)
    most[frequent] = 1
    parts = -(-size // most)
    if len(parts) and parts.max() > 1:
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        total, most, frequent = np.repeat(size, parts), np.repeat(most, parts), np.repeat(frequent, parts)
        first = np.repeat(first, parts) + nth * most
        size = np.minimum(most, total - nth * most)
    string = _mix(_mix(whole[first] + size.astype(np.uint64)) ^ whole[first + size - 1])
    name = np.where(frequent, _mix(whole[first] ^ np.uint64(_BASE)), least[first])
    return name & LOW40, string, first, size


def _among(x: np.ndarray, chosen: np.ndarray | None) -> np.ndarray:
    """Which of ``x`` are in the sorted ``chosen``."""
    if chosen is None or not len(chosen):
        return np.zeros(len(x), bool)
    return chosen[np.minimum(np.searchsorted(chosen, x), len(chosen) - 1)] == x


def _window_hash(h1: np.ndarray, width: int) -> np.ndarray:
    out, done = None, 0
    power, n = h1, 1
    left = width
    while left:
        if left & 1:
            out = power if out is None else _join(out, power, n, done)
            done += n
        left >>= 1
        if left:
            power, n = _join(power, power, n, n), 2 * n
    return out


class Batch:
    """A batch of documents: its table, ids, joined bytes and runs."""

    def __init__(self, blob: bytes, doc_id: str, text: str, width: int, hot: np.ndarray | None = None):
        self.hot = hot
        self.table = pa.ipc.open_stream(blob).read_all()
        ids = self.table.column(doc_id).cast(pa.int64()).combine_chunks()
        self.ids = ids.fill_null(LAST_ID).to_numpy(zero_copy_only=False)
        raw = pa.concat_arrays([pa.array([], pa.large_binary()), *self.table.column(text).cast(pa.large_binary()).fill_null(b"").chunks])
        offsets = np.frombuffer(raw.buffers()[1], np.int64, len(raw) + 1, 8 * raw.offset)
        self.sizes, self.ends = np.diff(offsets), offsets[1:] - offsets[0]
        self.data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        found, start, lower = [], 0, 0
        while start < len(raw):  # some texts at a time, to bound the working arrays
            stop = max(start + 1, int(np.searchsorted(self.ends, lower + 65_536, side="right")))
            upper = int(self.ends[stop - 1])
            gram, string, first, size = self._some(lower, upper, self.ends[start:stop] - lower, width)
            found.append((gram, string, first + lower, size))
            start, lower = stop, upper
        if not found:
            found.append(runs(self.data, self.ends, width, hot))
        self.gram, self.string, self.first, self.size = [np.concatenate(c) for c in zip(*found, strict=True)]
        self.doc = np.searchsorted(self.ends, self.first, side="right")

    def _some(self, lower: int, upper: int, ends: np.ndarray, width: int):
        """Runs of a stretch; a very long text is taken in overlapping pieces."""
        step, out = 1_000_000, []
        for a in range(0, max(1, upper - lower), step):
            b = min(upper - lower, a + step + width - 1)
            if b - a >= width or a == 0:
                within = ends[(ends > a) & (ends <= b)] - a
                gram, string, first, size = runs(self.data[lower + a : lower + b], within, width, self.hot)
                out.append((gram, string, first + a, size))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))

    def distinct(self, shards: int) -> None:
        """Names the distinct runs: ``group`` of every run; ``chosen`` run, least id and place in ``by_shard`` of every group.

        Groups lie by shard, within it in the order of documents: a run is known by shard and place there.
        """
        order = np.argsort(self.string, kind="stable")
        g, s = self.gram[order], self.string[order]
        new = np.ones(len(order), bool)
        new[1:] = (s[1:] != s[:-1]) | (g[1:] != g[:-1])
        at = np.flatnonzero(new)
        chosen, least = order[at], np.minimum.reduceat(self.ids[self.doc[order]], at) if len(at) else np.zeros(0, np.int64)
        shard = (self.gram[chosen] % np.uint64(shards)).astype(np.int64)
        by_shard = np.lexsort((chosen, shard))
        name = np.empty(len(at), np.int64)
        name[by_shard] = np.arange(len(at))
        self.group = np.empty(len(order), np.int64)
        self.group[order] = np.repeat(name, np.diff(np.append(at, len(order))))
        self.chosen, self.least, self.shard = chosen[by_shard], least[by_shard], shard[by_shard]

    def places(self, shard: int, at: bytes) -> np.ndarray:
        """Groups of the runs that a shard names by their places."""
        return np.searchsorted(self.shard, shard) + np.frombuffer(at, "<i4")


def _pack40(x: np.ndarray) -> bytes:
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _unpack40(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return out.view("<u8")[:, 0]


_BLOCK = [("kind", pa.int32()), ("target", pa.int64()), ("shard", pa.int64()), ("place", pa.binary()), ("number", pa.binary()), ("body", pa.binary())]
BLOCK = "kind int, target long, shard long, place binary, number binary, body binary"
SETTLED, ASKED, PENDING, SPELT, REFINED, STRETCH = range(6)


def _table(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in _BLOCK]
    return pa.table({name: pa.array(c, kind) for (name, kind), c in zip(_BLOCK, columns, strict=True)})


def _by(target: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each distinct target and the places that have it."""
    order = np.argsort(target, kind="stable")
    cuts = np.flatnonzero(np.diff(target[order])) + 1
    for part in np.split(order, cuts):
        if len(part):
            yield int(target[part[0]]), part


def _settle(block: pa.Table, stretch_runs: int) -> pa.Table:
    """Settles the buckets of one shard; asks for the strings of mixed ones, to be refined in stretches of some q-grams."""
    grams = [_unpack40(x) for x in block.column("gram").to_pylist()]
    batch = np.repeat(np.array(block.column("batch").to_pylist(), np.int64), [len(g) for g in grams])
    place = np.concatenate([np.arange(len(g), dtype="<i4") for g in grams])
    gram = np.concatenate(grams)
    del grams
    string = np.concatenate([np.frombuffer(x, "<u8") for x in block.column("string").to_pylist()])
    number = np.concatenate([np.frombuffer(x, "<i8") for x in block.column("number").to_pylist()])
    shard = block.column("shard")[0].as_py()
    order = np.lexsort((number, string, gram))
    gram, string, number, batch, place = gram[order], string[order], number[order], batch[order], place[order]
    new_gram = np.ones(len(order), bool)
    new_gram[1:] = gram[1:] != gram[:-1]
    new_run = new_gram.copy()
    new_run[1:] |= string[1:] != string[:-1]
    run = (np.cumsum(new_run) - 1).astype("<i4")
    first = number[np.flatnonzero(new_run)][run]
    strings = np.bincount(np.cumsum(new_gram) - 1, new_run)[np.cumsum(new_gram) - 1]
    rows = []
    at = np.flatnonzero((strings == 1) & (number > first))
    for target, part in _by(batch[at]):
        p = at[part]
        rows.append((SETTLED, target, shard, place[p].tobytes(), first[p].astype("<i8").tobytes(), b""))
    at = np.flatnonzero((strings > 1) & new_run)
    for target, part in _by(batch[at]):
        p = at[part]
        rows.append((ASKED, target, shard, place[p].tobytes(), first[p].astype("<i8").tobytes(), run[p].tobytes()))
    at = np.flatnonzero(strings > 1)
    if len(at):
        rows.append((PENDING, shard, shard, place[at].tobytes(), batch[at].astype("<i8").tobytes(), run[at].tobytes()))
        opens = run[np.flatnonzero(new_gram & (strings > 1))]  # first runs of q-grams
        first_of = opens[np.flatnonzero(np.diff(opens // stretch_runs, prepend=-1))]
        rows.append((STRETCH, shard, shard, first_of.tobytes(), b"", b""))
    return _table(rows)


def refine(text: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Bucket identifiers of the windows at ``starts``, equal for equal windows.

    Suffix buckets of 8 bytes are refined by the identifiers of later offsets
    until they cover ``width`` bytes (16 at least).
    """
    padded = np.concatenate([text, np.zeros(width + 8, np.uint8)])
    eight = np.lib.stride_tricks.sliding_window_view(padded, 8)[: len(text) + width]
    pointer = np.unique(np.ascontiguousarray(eight).view(">u8")[:, 0], return_inverse=True)[1].astype(np.int64)
    depth = 8
    while depth < width:
        step = min(depth, width - depth)
        open_ = np.flatnonzero(np.bincount(pointer)[pointer[:-step]] > 1)  # buckets of one suffix are settled
        top = np.int64(pointer.max() + 1)
        finer = np.unique(pointer[open_] * top + pointer[open_ + step], return_inverse=True)[1]
        pointer[open_] = top + finer
        depth += step
    return pointer[starts]


def _refine_shard(width: int):
    def run(pending: pa.Table, spelt: pa.Table) -> pa.Table:
        if not pending.num_rows or not spelt.num_rows:
            return _table([])
        named = np.concatenate([np.frombuffer(x, "<i4") for x in spelt.column("place").to_pylist()])
        meta = np.concatenate([np.frombuffer(x, "<i8").reshape(-1, 2) for x in spelt.column("number").to_pylist()])
        text = np.frombuffer(b"".join(spelt.column("body").to_pylist()), np.uint8)
        kind = np.array(pending.column("kind").to_pylist())
        opens = np.frombuffer(pending.column("place")[int(np.flatnonzero(kind == STRETCH)[0])].as_py(), "<i4")
        pending = pending.filter(pa.array(kind == PENDING))
        begin = np.cumsum(meta[:, 1] + width - 1) - (meta[:, 1] + width - 1)
        order = np.argsort(named)
        named, first_doc, windows, begin = named[order], meta[order, 0], meta[order, 1], begin[order]
        base = np.cumsum(windows) - windows
        answer = np.empty(windows.sum(), np.int64)
        cuts = [*np.searchsorted(named, opens).tolist(), len(named)]
        for lower, upper in zip(cuts, cuts[1:], strict=False):  # q-grams share no window, so some are refined at a time
            n = windows[lower:upper]
            length = n + width - 1
            inside = np.cumsum(length) - length
            part = text[np.repeat(begin[lower:upper] - inside, length) + np.arange(length.sum())]
            starts = np.repeat(inside - (base[lower:upper] - base[lower]), n) + np.arange(n.sum())
            bucket = np.unique(refine(part, starts, width), return_inverse=True)[1]
            least = np.full(bucket.max() + 1, LAST_ID)
            np.minimum.at(least, bucket, np.repeat(first_doc[lower:upper], n))
            answer[base[lower] : base[lower] + n.sum()] = least[bucket]
        spelt_at = np.full(named.max() + 1, -1)
        spelt_at[named] = np.arange(len(named))
        shard = pending.column("shard")[0].as_py()
        place = np.concatenate([np.frombuffer(x, "<i4") for x in pending.column("place").to_pylist()])
        batch = np.concatenate([np.frombuffer(x, "<i8") for x in pending.column("number").to_pylist()])
        at = spelt_at[np.concatenate([np.frombuffer(x, "<i4") for x in pending.column("body").to_pylist()])]
        rows = []
        for target, part in _by(batch):
            run_of = at[part]
            n = windows[run_of]
            window = np.repeat(base[run_of] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            rows.append((REFINED, target, shard, place[part].tobytes(), n.astype("<i8").tobytes(), answer[window].astype("<i8").tobytes()))
        return _table(rows)

    return run


def hot_grams(docs: DataFrame, width: int, gram_runs: int, text: str = "text", sample_bytes: int = 64 << 20) -> np.ndarray:
    """Sorted q-grams that about ``gram_runs`` or more distinct runs have, by a sample of texts (copies count once)."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    share = min(1.0, max(40 / gram_runs, sample_bytes / max(1, total)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0).to_pylist():
                data = np.frombuffer(t.encode(), np.uint8)
                for a in range(0, len(data), 1_000_000):
                    piece = data[a : a + 1_000_000 + width - 1]
                    gram, string, _, _ = runs(piece, np.array([len(piece)]), width)
                    if len(gram):
                        yield pa.RecordBatch.from_arrays([pa.array(gram.astype(np.int64)), pa.array(string.astype(np.int64))], ["gram", "string"])

    chosen = docs.select(text).where(F.col(text).isNotNull() & (F.pmod(F.xxhash64(F.lit(11), text), F.lit(1 << 20)) < int(share * (1 << 20))))
    counted = chosen.mapInArrow(run, "gram long, string long").distinct().groupBy("gram").count().where(F.col("count") >= gram_runs * share)
    return np.sort(counted.select("gram").toArrow().column("gram").combine_chunks().to_numpy(zero_copy_only=False).astype(np.uint64))


def remove_repeats(docs: DataFrame, width: int = 50, doc_id: str = "doc_id", text: str = "text", batch_bytes: int = 6 << 20, shard_bytes: int = 12 << 20, gram_runs: int = 20_000, stretch_runs: int = 8192) -> DataFrame:
    """All columns of ``docs`` with the kept text, and ``n_bytes, n_removed, n_spans, kept_sha256``."""
    if width < GRAM + 12:
        raise ValueError(f"width must be at least {GRAM + 12}")
    results = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
    docs = docs.drop(*results).withColumn(text, F.col(text).cast("string"))
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))

    frequent = docs.sparkSession.sparkContext.broadcast(hot_grams(docs, width, gram_runs, text))  # 8 bytes for 40 or more sampled runs

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get().partitionId(), 0
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for batch in batches:
            at = batch.schema.get_field_index(text)
            sizes = np.array([len(t) if t else 0 for t in batch.column(at).to_pylist()])
            group = np.cumsum(sizes) // batch_bytes
            cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b > a:
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, batch.schema, options=options) as writer:
                        writer.write_batch(batch.slice(a, b - a))
                    yield pa.RecordBatch.from_arrays([pa.array([task << 32 | n], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["batch", "blob"])
                    n += 1

    held = cut(docs.mapInArrow(gather, "batch long, blob binary"))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for number, blob in zip(rows.column(0).to_pylist(), rows.column(1), strict=True):
                b = Batch(blob.as_buffer(), doc_id, text, width, frequent.value)
                b.distinct(shards)
                out: list[tuple] = []
                cuts = np.flatnonzero(np.diff(b.shard, prepend=-1, append=-1))
                for lower, upper in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
                    p = b.chosen[lower:upper]
                    out.append((int(b.shard[lower]), number, _pack40(b.gram[p]), b.string[p].astype("<u8").tobytes(), b.least[lower:upper].astype("<i8").tobytes()))
                if out:
                    columns = list(zip(*out, strict=True))
                    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["shard", "batch", "gram", "string", "number"])

    sent = held.mapInArrow(spread, "shard long, batch long, gram binary, string binary, number binary")
    settled = cut(sent.groupBy("shard").applyInArrow(lambda block: _settle(block, stretch_runs), BLOCK))

    def spell(left: pa.Table, right: pa.Table) -> pa.Table:
        """Strings of the runs that the right side asks for."""
        if not left.num_rows or not right.num_rows:
            return _table([])
        b = Batch(left.column("blob")[0].as_buffer(), doc_id, text, width, frequent.value)
        b.distinct(shards)
        rows = []
        for r in right.to_pylist():
            run = b.chosen[b.places(r["shard"], r["place"])]
            body = b"".join([b.data[s:e].tobytes() for s, e in zip(b.first[run].tolist(), (b.first[run] + b.size[run] + width - 1).tolist(), strict=True)])
            meta = np.stack([np.frombuffer(r["number"], "<i8"), b.size[run]], axis=1)
            rows.append((SPELT, r["shard"], r["shard"], r["body"], meta.astype("<i8").tobytes(), body))
        return _table(rows)

    asked = settled.where(F.col("kind") == ASKED).withColumnRenamed("target", "batch")
    spelt = held.groupBy("batch").cogroup(asked.groupBy("batch")).applyInArrow(spell, BLOCK)
    pending = settled.where(F.col("kind").isin(PENDING, STRETCH))
    refined = pending.groupBy("target").cogroup(spelt.groupBy("target")).applyInArrow(_refine_shard(width), BLOCK)
    answers = cut(refined).unionByName(settled.where(F.col("kind") == SETTLED)).withColumnRenamed("target", "batch")
    schema = T.StructType(list(docs.schema.fields))
    for name, kind in zip(results, ("long", "long", "long", "string"), strict=True):
        schema = schema.add(name, kind)

    def apply(left: pa.Table, right: pa.Table) -> pa.Table:
        b = Batch(left.column("blob")[0].as_buffer(), doc_id, text, width, frequent.value)
        b.distinct(shards)
        group, first = b.group, b.least.copy()
        change = np.zeros(len(b.data) + 1, np.int32)
        own = b.ids[b.doc]
        fine = np.full(len(first), -1, np.int64)
        pool, offset = [], 0
        for r in right.to_pylist():
            place = b.places(r["shard"], r["place"])
            number = np.frombuffer(r["number"], "<i8")
            if r["kind"] == SETTLED:
                first[place] = number
            else:
                fine[place] = offset + np.cumsum(number) - number
                pool.append(np.frombuffer(r["body"], "<i8"))
                offset += len(pool[-1])
        gone = (first[group] < own) & (fine[group] < 0)
        np.add.at(change, b.first[gone], 1)
        np.add.at(change, b.first[gone] + b.size[gone] + width - 1, -1)
        mixed = np.flatnonzero(fine[group] >= 0)
        if len(mixed):
            pool = np.concatenate(pool)
            n = b.size[mixed]
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            window = np.repeat(b.first[mixed], n) + step
            window = window[pool[np.repeat(fine[group[mixed]], n) + step] < np.repeat(own[mixed], n)]
            np.add.at(change, window, 1)
            np.add.at(change, window + width, -1)
        covered = np.cumsum(change[:-1]) > 0
        kept, removed, spans, digest = [], [], [], []
        for end, size in zip(b.ends.tolist(), b.sizes.tolist(), strict=True):
            mask = covered[end - size : end]
            rest = b.data[end - size : end][~mask].tobytes()
            kept.append(rest.decode("utf-8", errors="ignore"))
            removed.append(size - len(rest))
            spans.append(int(np.count_nonzero(mask[1:] & ~mask[:-1]) + (size > 0 and bool(mask[0]))))
            digest.append(hashlib.sha256(rest).hexdigest())
        table = b.table
        was = table.column(text)
        kept = [None if not w.is_valid else k for w, k in zip(was, kept, strict=True)]
        table = table.set_column(table.schema.get_field_index(text), text, pa.array(kept, was.type))
        for name, values in zip(results, (b.sizes.tolist(), removed, spans), strict=False):
            table = table.append_column(name, pa.array(values, pa.int64()))
        return table.append_column("kept_sha256", pa.array(digest, pa.string()))

    return held.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(apply, schema)
