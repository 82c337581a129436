"""Sharding by a histogram sort, in DataFrame functions only; the law is ``bytes``.

Rows get a 63-bit key: 39 bits of the text's hash, so that equal texts lie side
by side, then 24 bits of a hash of the row's id and its ordinal, so that a group
of copies of any size can still be cut, be their ids equal or null. The ordinal
is the row's place in its partition; the first written table fixes it. Exact bytes below evenly spaced candidate boundaries are
counted on all partitions; the next round probes only inside the intervals that
still hold a splitter, until an interval's bytes are within the tolerance. Only
those counts (at most 4096 for each open splitter) reach the driver. Then each
row is dealt to its shard, in one exchange of the rows.

Defined results: a null text has 0 bytes and CRC 0, and still a size of 16.
Equal keys stay together: a 2^24th of the rows of one text at most, by
expectation, so shards differ by at most the tolerance and one long row or such a
run. Which shard gets which of several equal rows is open. Fewer rows than shards leave shards empty; an empty table gives
an empty result. Repeated rows get slots of their own; other columns of the
input are not returned.
"""

from __future__ import annotations

import bisect

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodestone.llm.common import cut

KEY_BITS, STEP_BITS, ROW_BYTES = 63, 12, 16


def sized(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, key, ordinal, size, text_crc32`` of every row; to be written before it is used twice."""
    whole = F.coalesce(F.col(text), F.lit(""))
    high = F.shiftleft(F.shiftrightunsigned(F.xxhash64(whole), 64 - 39), 24)
    numbered = docs.withColumn("__ordinal", F.monotonically_increasing_id())
    low = F.xxhash64(F.col(doc_id), F.col("__ordinal")).bitwiseAND(F.lit((1 << 24) - 1))
    return numbered.select(
        F.col(doc_id).alias("doc_id"),
        high.bitwiseOR(low).alias("key"),
        F.col("__ordinal").alias("ordinal"),
        (F.octet_length(whole) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(F.encode(whole, "UTF-8")).alias("text_crc32"),
    )


def find_splitters(rows: DataFrame, n_shards: int, tolerance: float = 0.001) -> list[int]:
    """``n_shards - 1`` boundaries of ``key``: a row belongs to the shard after all boundaries at or below its key."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    targets = [total * i // n_shards for i in range(1, n_shards)]
    slack = max(1, int(total / n_shards * tolerance))
    found: dict[int, int] = {}
    open_bins, width = {0: (0, list(range(len(targets))))}, KEY_BITS  # bin: bytes below it, splitters in it
    while open_bins and total:
        finer = max(0, width - STEP_BITS)
        inside = rows if width == KEY_BITS else rows.where(F.shiftright("key", width).isin(list(open_bins)))
        counts = inside.groupBy(F.shiftright("key", finer).alias("bin")).agg(F.sum("size").alias("bytes")).collect()
        by_parent: dict[int, list[tuple[int, int]]] = {}
        for row in counts:
            by_parent.setdefault(row["bin"] >> (width - finer), []).append((row["bin"], row["bytes"]))
        narrower: dict[int, tuple[int, list[int]]] = {}
        for parent, (below, wanted) in open_bins.items():
            bins = sorted(by_parent[parent])
            ends = [below := below + size for _, size in bins]
            for i in wanted:
                k = min(bisect.bisect_left(ends, targets[i]), len(bins) - 1)
                start = ends[k] - bins[k][1]
                if bins[k][1] <= slack or not finer:
                    nearer_end = ends[k] - targets[i] < targets[i] - start
                    found[i] = (bins[k][0] + nearer_end) << finer
                else:
                    narrower.setdefault(bins[k][0], (start, []))[1].append(i)
        open_bins, width = narrower, finer
    return [found.get(i, 0) for i in range(len(targets))]


def _shard_of(key: Column, splitters: list[int]) -> Column:
    shard = F.lit(0)
    for boundary in splitters:
        shard = shard + (key >= F.lit(boundary)).cast("int")
    return shard


def shard(docs: DataFrame, n_shards: int = 40, rows_per_bucket: int = 50_000, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot``: every row, dealt to ``n_shards`` shards of nearly equal bytes.

    Slots number a shard's rows without gaps: rows are ranked within bounded
    buckets of a shard and raised by the counts of the buckets before, so no
    task ranks a whole shard.
    """
    rows = cut(sized(docs, doc_id, text))
    splitters = find_splitters(rows, n_shards)
    buckets = max(1, -(-rows.count() // (rows_per_bucket * n_shards)))
    dealt = rows.withColumns(
        {"shard": _shard_of(F.col("key"), splitters), "bucket": F.pmod(F.xxhash64("ordinal"), F.lit(buckets))}
    )
    counts = dealt.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = counts.select(
        "shard",
        "bucket",
        (F.sum("n").over(W.partitionBy("shard").orderBy("bucket")) - F.col("n")).alias("base"),
    )
    ranked = dealt.withColumn("rank", F.row_number().over(W.partitionBy("shard", "bucket").orderBy("key", "ordinal")))
    return ranked.join(before, ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("rank") - 1).alias("slot")
    )
