"""SimHash near-dedup of documents whose sets of word shingles have an exact Jaccard similarity of 0.8 or more.

The form of :mod:`lodestone.llm.simhash` for a similarity in place of a radius. Two
sets of similarity 0.8 differ in 10 bits of 64 on average and in up to 26 at times;
agreeing parts of the bits find no such pairs, so buckets come from minima instead.

1. Each text becomes the set of XXH64 hashes (seed 42) of its shingles; equal sets
   fold into one node. A node has a fingerprint (the majority of its hashes' bits)
   and 28 bands of four minima each: two sets of similarity 0.8 agree in no band with
   a probability of 4e-7.
2. Nodes that agree in a band form a bucket; of buckets with the same members one is kept.
   The sets of nodes that share a bucket are made again from their texts and written, so
   those of all other texts are never stored. Seven bands come first; of the others only
   buckets that still hold more than one component are compared.
3. A bucket is cut into blocks by hash, each with the bucket's smallest node added. In a
   block, fingerprints are compared bit-sliced (planes, carry-save counters); pairs within
   26 bits (at 0.8 others are rarer than one in a million) are decided on the whole sets, and so
   are pairs with a set of fewer than 64 shingles, unless bitmaps show that they share too few.
4. Buckets of several blocks that still hold more than one component are compared
   again as pairs of blocks, so that no pair is lost and no task grows with a bucket.
   A block sends on at most one link a node.

Words are those of :mod:`lodestone.llm.simhash`. Texts without words link with each other only.
Columns named ``__key``, ``__no_id`` and ``__id0`` are not kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import components, cut
from lodestone.llm.simhash import _LOWER, planes, within

BANDS, ROWS, FIRST, RADIUS = 28, 4, 7, 26
#: For sets smaller than this fingerprints tell nothing, as few shingles make them differ in more bits; bitmaps bound what they share.
SMALL, MAP_BITS = 64, 1024
#: Sets that a Python group holds at once, in bytes on average.
SHARD_BYTES = 64 << 20
_RNG = np.random.default_rng(5)
_SCALE = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
BUCKET = ["band", "value"]


def shingles(text: bytes, shingle_words: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the shingles; fewer words than a shingle: of the whole sequence."""
    words = text.translate(_LOWER).split()
    n = min(shingle_words, len(words))
    made = {b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()
    return np.array(sorted(xxhash.xxh64_intdigest(s, 42) for s in made), np.uint64)


def bands(hashes: np.ndarray) -> list[int]:
    """Hashes of the groups of minima."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(hashes), 4096):
        x = hashes[start : start + 4096, None]
        mixed = (x ^ (x >> np.uint64(29))) * _SCALE + _SHIFT
        least = np.minimum(least, (mixed ^ (mixed >> np.uint64(32))).min(0))
    return [xxhash.xxh64_intdigest(row.tobytes()) - (1 << 63) for row in least.reshape(BANDS, ROWS)]


def majority(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes."""
    votes = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 8192):
        votes += np.unpackbits(hashes[start : start + 8192].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(hashes)).tobytes(), "big")


def marked(docs: DataFrame, shingle_words: int = 5) -> DataFrame:
    """``doc_id, key, node, fp, bands`` of ``doc_id, __key, text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t.as_buffer().to_pybytes() if t.is_valid else b"", shingle_words) for t in batch.column(2)]
            node = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            fp = np.array([majority(s) for s in sets], np.uint64).view(np.int64)
            columns = [batch.column(0), batch.column(1), pa.array(node), pa.array(fp), pa.array([bands(s) for s in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "node", "fp", "bands"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("__key").alias("key"), F.encode("text", "UTF-8").alias("text"))
    return slim.mapInArrow(run, "doc_id long, key long, node long, fp long, bands array<long>")


def bitmaps(sets: list[np.ndarray], chosen: np.ndarray) -> np.ndarray:
    """For each chosen set the ``MAP_BITS`` bits that its hashes' last bits name; zeros for the others."""
    maps = np.zeros((len(sets), MAP_BITS // 64), np.uint64)
    at = np.flatnonzero(chosen)
    if len(at):
        row = np.repeat(at, [len(sets[k]) for k in at])
        bit = np.concatenate([sets[k] for k in at]) % np.uint64(MAP_BITS)
        np.bitwise_or.at(maps, (row, (bit >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (bit & np.uint64(63)))
    return maps


def parts(sets: list[np.ndarray], fps: np.ndarray, similarity: float, radius: int = RADIUS) -> np.ndarray:
    """For each set the first one of its connected part; links are pairs of ``similarity`` within ``radius`` bits, or with a small set."""
    size = np.array([len(s) for s in sets])
    part, unseen, small = np.arange(len(sets)), size > 0, size < SMALL
    maps = bitmaps(sets, size * similarity < SMALL)  # a pair with a small set has two of these
    unmapped = size - np.bitwise_count(maps).sum(1, dtype=np.int64)  # hashes that share a bit with another one of the set
    near = within(fps, planes(fps), len(fps), radius)
    bits = lambda row: np.unpackbits(row.view(np.uint8), count=len(fps), bitorder="little").astype(bool)
    for root in np.flatnonzero(size):
        if not unseen[root]:
            continue
        unseen[root] = False
        front = [root]
        while front:
            q = front.pop()
            fits = (size >= similarity * size[q] - 1e-9) & (size * similarity <= size[q] + 1e-9)
            at = np.flatnonzero((bits(near[q]) | small | small[q]) & unseen & fits)
            tiny = small[at] | small[q]
            shared = np.bitwise_count(maps[at[tiny]] & maps[q]).sum(1, dtype=np.int64) + unmapped[q]  # at least what they have in common
            tiny[tiny] = shared * (1 + similarity) < similarity * (size[at[tiny]] + size[q]) - 1e-9
            at = at[~tiny]
            if not len(at):
                continue
            joined = np.concatenate([sets[k] for k in at])
            place = np.minimum(np.searchsorted(sets[q], joined), size[q] - 1)
            begin = np.cumsum(size[at]) - size[at]
            both = np.add.reduceat((sets[q][place] == joined).astype(np.int64), begin)
            linked = at[both * (1 + similarity) >= similarity * (size[at] + size[q]) - 1e-9]
            unseen[linked] = False
            part[linked] = root
            front.extend(linked.tolist())
    return part


def _linker(similarity: float):
    def link(shard: pd.DataFrame) -> pd.DataFrame:
        a, b = [], []
        for _, cell in shard.groupby([*BUCKET, "i", "j"], sort=False):
            cell = cell.drop_duplicates("node").sort_values("node")
            node = cell["node"].to_numpy()
            part = parts([np.frombuffer(h, np.uint64) for h in cell["hashes"]], cell["fp"].to_numpy().view(np.uint64), similarity)
            other = part != np.arange(len(part))
            a.append(node[other])
            b.append(node[part[other]])
        return pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)})

    return link


ROW = ["__no_id", "__id0", "__key"]


def _first_row(doc_id: str = "doc_id", key: str = "key") -> Column:
    """The columns that tell a row by id and text; of several the smallest comes first, rows without an id last."""
    value = F.coalesce(F.col(doc_id), F.lit(0))
    return F.min(F.struct(F.col(doc_id).isNull().alias("__no_id"), value.alias("__id0"), F.col(key).alias("__key"))).alias("f")


def _sets(rows: DataFrame, held: DataFrame, wanted: DataFrame, shingle_words: int) -> DataFrame:
    """``node, fp, hashes, size`` of the wanted nodes, made from the text of one row of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [shingles(t.as_buffer().to_pybytes() if t.is_valid else b"", shingle_words).tobytes() for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(raw, pa.binary())], ["node", "fp", "hashes"])

    chosen = cut(held.join(wanted, "node", "left_semi").select("node", "fp", "f.*"))
    made = rows.join(chosen, ROW).select("node", "fp", F.encode("text", "UTF-8").alias("text")).mapInArrow(run, "node long, fp long, hashes binary")
    held = made.groupBy("node").agg(F.min("fp").alias("fp"), F.min("hashes").alias("hashes"))  # repeated rows fold
    return cut(held.withColumn("size", F.octet_length("hashes") / 8))


def links(rows: DataFrame, held: DataFrame, similarity: float = 0.8, shingle_words: int = 5, block: int = 512) -> DataFrame:
    """``a, b``: links that join all nodes of the written table ``held`` (``node, fp, bands, f``) at ``similarity`` or more into their components."""
    placed = cut(held.select("node", F.posexplode("bands").alias("band", "value")))
    shared = placed.groupBy(*BUCKET).agg(F.count("*").alias("n")).where("n > 1").select(*BUCKET)
    placed = cut(placed.join(shared, BUCKET, "left_semi"))
    sets = _sets(rows, held, placed.select("node").distinct(), shingle_words)
    mean_size = sets.agg(F.avg("size")).first()[0] or 0
    mine = F.pmod(F.xxhash64(F.lit(3), "node"), F.col("blocks")).cast("int")
    every = F.sequence(F.lit(0), F.col("blocks") - 1)

    def linked(cells: DataFrame) -> DataFrame:
        n = cells.count()
        shards = max(1, n // 4096, int(n * mean_size * 8) // SHARD_BYTES)
        met = cells.join(sets.drop("size"), "node").withColumn("shard", F.pmod(F.xxhash64(*BUCKET, "i", "j"), F.lit(shards)))
        return cut(met.groupBy("shard").applyInPandas(_linker(similarity), "a long, b long"))

    def open_buckets(members: DataFrame, known: DataFrame | None) -> DataFrame:
        """Buckets of more than one component, one of those with the same members: their smallest node and blocks."""
        own = members.withColumn("component", F.col("node")) if known is None else members.join(known, "node", "left").withColumn("component", F.coalesce("component", "node"))
        n, least, last = F.count("*").alias("n"), F.min("node").alias("hub"), F.max("node").alias("last")
        met = own.groupBy(*BUCKET).agg(n, least, last, F.bit_xor(F.xxhash64("node")).alias("all"), F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
        one = met.groupBy("n", "hub", "last", "all").agg(F.min(F.struct(*BUCKET)).alias("b"))
        return one.select("b.*", "hub", F.ceil(F.col("n") / block).cast("int").alias("blocks"))

    found, known = None, None
    for lower, upper in ((0, FIRST), (FIRST, BANDS)):
        some = placed.where(F.col("band").between(lower, upper - 1))
        members = cut(some.join(open_buckets(some, known), BUCKET))
        place = F.explode(F.when(F.col("node") == F.col("hub"), every).otherwise(F.array(mine)))
        new = linked(members.withColumn("i", place).select("node", *BUCKET, "i", F.col("i").alias("j")))
        found = new if found is None else found.unionByName(new)
        known = components(found)
        large = cut(members.where("blocks > 1"))
        if not large.isEmpty():
            left = large.join(open_buckets(large, known).select(*BUCKET), BUCKET, "left_semi").withColumn("mine", mine).withColumn("other", F.explode(every))
            found = found.unionByName(linked(left.select("node", *BUCKET, F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))))
            known = components(found)
    return found


def one_of_each(docs: DataFrame, similarity: float = 0.8, shingle_words: int = 5, block: int = 512) -> DataFrame:
    """One row of each component: the smallest id, rows without an id last. Rows are told apart by id and text."""
    keyed = docs.withColumn("__key", F.xxhash64("text"))
    rows = keyed.withColumns({"__no_id": F.col("doc_id").isNull(), "__id0": F.coalesce(F.col("doc_id").cast("long"), F.lit(0))})
    held = cut(marked(keyed, shingle_words).groupBy("node").agg(F.min("fp").alias("fp"), F.first("bands").alias("bands"), _first_row()))  # copies fold
    found = components(links(rows, held, similarity, shingle_words, block))
    named = held.select("node", "f").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    chosen = cut(named.groupBy("component").agg(F.min("f").alias("f")).select("f.*"))
    return rows.join(chosen, ROW, "left_semi").dropDuplicates(ROW).select(docs.columns)
