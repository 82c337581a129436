"""Near-duplicate documents by SimHash, compared bit-sliced.

1. Each text gets a 64-bit fingerprint: a bit is 1 if it is set in over half of
   the XXH64 hashes (seed 42) of its word shingles.
2. Equal fingerprints fold into one row (partial aggregation, so a group of
   copies of any size costs one row per task).
3. Two fingerprints within ``radius`` bits agree wholly on at least one of
   ``radius + 1`` parts of the 64 bits (or on two of ``radius + 2`` parts, when
   there are many). Each part is a table, its leading bits the bucket.
   A bucket above ``block`` rows is cut into blocks by hash and compared as
   pairs of blocks, so every task gets a bounded number of rows and no pair is lost.
4. Within a block pair the fingerprints of one side lie as 64 vertical bit
   planes. Rows of the other side are XORed against the planes, distances are
   counted in carry-save bitwise counters for 64 lanes a machine word, and a row
   is abandoned once all its lanes exceed the radius.
5. A block sends on at most one link per row (to the smallest row of its
   connected part); the components of all links are the groups. Fingerprints are
   the nodes, so rows without an id join groups like any other.

The last join brings a group's id to its rows by fingerprint; all copies of one
text share that key, and adaptive execution splits it by rows of the written
table.

Defined results: words are maximal runs outside ASCII white space, A-Z in lower
case. Fewer words than a shingle: the whole sequence; no words (empty or null
text): fingerprint zero, which links like any other. ``doc_id`` is returned as
a long. Repeated rows are returned each. A null id counts as none when the
smallest is chosen; a group without any id has a null component. Other columns
of the input are not returned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import components, cut

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: bytes, shingle_words: int = 4) -> int:
    """Majority of the bits of the shingles' hashes, as an unsigned integer."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    n = min(shingle_words, len(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_digest
    hashes = b"".join(
        [digest(line[s:e], 42) for s, e in zip(starts[: len(words) - n + 1].tolist(), ends[n - 1 :].tolist(), strict=True)]
    )
    rows = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
    votes = sum(np.unpackbits(part, axis=1).sum(0, dtype=np.int64) for part in np.array_split(rows, len(rows) // 8192 + 1))
    return int.from_bytes(np.packbits(2 * votes > len(rows)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle_words: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fp``: ``fp`` holds the fingerprint's 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", shingle_words) for t in batch.column(1)]
            fps = np.array(got, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["doc_id", "fp"])

    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.encode(F.col(text), "UTF-8").alias("text"))
    return slim.mapInArrow(run, "doc_id long, fp long")


def planes(fps: np.ndarray) -> np.ndarray:
    """64 bit planes of ``fps``, lanes packed 64 to a word; spare lanes repeat the first."""
    padded = np.concatenate([fps, np.repeat(fps[:1], -len(fps) % 64)])
    bits = ((padded[None, :] >> np.arange(64, dtype=np.uint64)[:, None]) & np.uint64(1)).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


def _add(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Carry-save adder: sum bit and carry of three bits in every lane."""
    u = a ^ b
    return u ^ c, (a & b) | (u & c)


def _exceeds(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose counter is above ``radius``; ``counters`` are its bits from ones on, the last one sticky."""
    above, equal = counters[-1].copy(), ~counters[-1]
    for bit, counter in reversed(list(enumerate(counters[:-1]))):
        if radius >> bit & 1:
            equal &= counter
        else:
            above |= equal & counter
            equal &= ~counter
    return above


def within(queries: np.ndarray, lanes: np.ndarray, n_lanes: int, radius: int) -> np.ndarray:
    """Bit matrix (queries x lane words): lanes at ``radius`` (0 to 31) or fewer differing bits of each query."""
    found = np.zeros((len(queries), lanes.shape[1]), np.uint64)
    full = np.packbits(np.arange(lanes.shape[1] * 64) < n_lanes, bitorder="little").view(np.uint64)
    n_counters = max(4, radius.bit_length() + 1)  # the last one holds all carries above
    for start in range(0, len(queries), 256):
        q = queries[start : start + 256]
        rows = np.arange(len(q))
        ones, twos, fours, *high = [np.zeros((len(q), lanes.shape[1]), np.uint64) for _ in range(n_counters)]
        flip = -((q[None, :] >> np.arange(64, dtype=np.uint64)[:, None]) & np.uint64(1)).astype(np.int64)
        flip = flip.view(np.uint64)
        for b in range(0, 64, 8):
            x = [lanes[b + i][None, :] ^ flip[b + i][rows][:, None] for i in range(8)]
            ones, two_a = _add(ones, x[0], x[1])
            ones, two_b = _add(ones, x[2], x[3])
            twos, four_a = _add(twos, two_a, two_b)
            ones, two_a = _add(ones, x[4], x[5])
            ones, two_b = _add(ones, x[6], x[7])
            twos, four_b = _add(twos, two_a, two_b)
            fours, carry = _add(fours, four_a, four_b)
            for k in range(len(high) - 1):
                high[k], carry = high[k] ^ carry, high[k] & carry
            high[-1] = high[-1] | carry
            near = ~_exceeds([ones, twos, fours, *high], radius) & full
            live = near.any(1)
            if not live.all():
                rows, near = rows[live], near[live]
                ones, twos, fours, *high = [c[live] for c in (ones, twos, fours, *high)]
                if not len(rows):
                    break
        found[start + rows] = near if len(rows) else 0
    return found


def _parts(matrix: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` nodes the first node of its connected part in a symmetric bit matrix."""
    part = np.arange(n)
    unseen = np.packbits(np.arange(matrix.shape[1] * 64) < n, bitorder="little").view(np.uint64)
    degree = np.bitwise_count(matrix).sum(1)
    for root in np.flatnonzero(degree > 1):
        if part[root] != root:
            continue
        front = np.array([root])
        unseen[root // 64] &= ~(np.uint64(1) << np.uint64(root % 64))
        while len(front):
            new = np.bitwise_or.reduce(matrix[front], axis=0) & unseen
            unseen &= ~new
            front = np.flatnonzero(np.unpackbits(new.view(np.uint8), bitorder="little"))
            part[front] = root
    return part


def _linker(radius: int):
    def link(cell: pd.DataFrame) -> pd.DataFrame:
        cell = cell.drop_duplicates("fp").sort_values("rep", kind="stable")
        fps, reps = cell["fp"].to_numpy().view(np.uint64), cell["rep"].to_numpy()
        part = _parts(within(fps, planes(fps), len(fps), radius), len(fps))
        other = part != np.arange(len(fps))
        return pd.DataFrame({"a": reps[other], "b": reps[part[other]]})

    return link


def _tables(n: int, radius: int, block: int) -> tuple[list[tuple[int, ...]], int, int]:
    """Tables (each the parts that must agree), the number of parts, and the bits of a bucket."""
    want = max(0, math.ceil(math.log2(max(1, n) / block)))
    extra = 1
    while 64 // (radius + extra) * extra < want and extra < 4:
        extra += 1
    return list(combinations(range(radius + extra), extra)), radius + extra, want


def links(fps: DataFrame, radius: int = 4, block: int = 1024) -> DataFrame:
    """``a, b``: links that join all rows of ``fp, rep`` within ``radius`` bits into their components.

    ``fps`` holds each fingerprint once; it should be a written table.
    """
    tables, n_parts, want = _tables(fps.count(), radius, block)
    cuts = [64 * i // n_parts for i in range(n_parts + 1)]

    def bucket(table: tuple[int, ...]):
        value, left = F.lit(0).cast("long"), want
        for k, p in enumerate(table):
            width = cuts[p + 1] - cuts[p]
            take = min(width, -(-left // (len(table) - k)))
            left -= take
            field = F.shiftrightunsigned("fp", cuts[p + 1] - take).bitwiseAND(F.lit((1 << take) - 1))
            value = F.shiftleft(value, take).bitwiseOR(field)
        return value

    placed = fps.select(
        "fp",
        "rep",
        F.posexplode(F.array(*[bucket(t) for t in tables])).alias("table", "bucket"),
    )
    large = (
        placed.groupBy("table", "bucket")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") > 4 * block)
        .select("table", "bucket", F.ceil(F.col("n") / (2 * block)).cast("int").alias("blocks"))
    )
    blocks = F.coalesce("blocks", F.lit(1))
    cut_up = (
        placed.join(large, ["table", "bucket"], "left")
        .withColumns({"blocks": blocks, "i": F.pmod(F.xxhash64("fp"), blocks).cast("int")})
        .withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("fp", "rep", "table", "bucket", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"))
    )
    return cut_up.groupBy("table", "bucket", "i", "j").applyInPandas(_linker(radius), "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = 4, shingle_words: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fp, component_id`` of every row: the smallest id reachable over links of ``radius`` or fewer bits."""
    marked = cut(fingerprints(docs, shingle_words, doc_id, text))
    fps = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = components(links(fps.select("fp", F.col("fp").alias("rep")), radius)).withColumnRenamed("node", "fp")
    named = cut(fps.join(found, "fp", "left").withColumn("component", F.coalesce("component", "fp")))
    first = named.groupBy("component").agg(F.min("least").alias("component_id"))
    groups = cut(named.join(first, "component").select("fp", "component_id"))
    return marked.join(groups, "fp").select("doc_id", "fp", "component_id")
