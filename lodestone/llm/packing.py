"""Best-fit packing of documents into token sequences by large-item matching.

1. Texts are encoded in the workers (a word is looked up once it is known to a
   worker); a document's ids end with ``end_id`` and only documents longer than
   the capacity are cut. The pieces' lengths and checksums are written once.
2. Only the histogram of lengths (at most ``capacity`` counts) reaches the driver.
   Pieces above a third of the capacity are matched greedily, the largest with
   the largest that fits, at most two a bin. Shorter ones, longest first, go to
   the smallest gap that holds them; new bins are opened when none does. Equal
   lengths are treated together, so the plan is a short list of slot runs
   whatever the number of documents.
3. A task numbers its own pieces of each length as it cuts them, in buckets of
   ``rows_per_bucket``; raised by the counts of the buckets before, that is a
   piece's rank, by which it looks its slot up. Nothing is sorted, and a frequent
   length is spread over as many buckets as tasks.

Defined results: a null or empty text packs as the single ``end_id``. Repeated
rows are packed one by one. Other columns of the input stay out. An empty table
gives an empty result.
"""

from __future__ import annotations

import bisect
import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from tokenizers import Tokenizer

from lodestone.llm.bpe import _byte_of_char, small_batches
from lodestone.llm.common import cut

_CHAR_OF = {b: c for c, b in _byte_of_char().items()}
_PLAIN = re.compile("([a-z\xdf-\xf6\xf8-\xff]+)([!-&(-/:-@\\[-`{-~]*)").fullmatch
_ODD_SPACE = re.compile("[\x1c-\x1f]").search


class WordIds:
    """Ids of whole texts under a vocabulary that drops white space, word by word through the library.

    White space separates words, and normalising keeps words apart, so the ids
    of a text are those of its words. Words are looked up in lower case where
    that is what the normaliser makes of them (texts within Latin-1).
    """

    def __init__(self, source: str, cache_size: int = 600_000):
        self.tokenizer = Tokenizer.from_str(source)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.cache: dict[str, bytes] = {}
        self.cores: dict[str, bytes] = {}
        self.cache_size = cache_size
        self.mapped = str.maketrans({chr(b): c for b, c in _CHAR_OF.items()})

    def _core(self, word: str) -> bytes:
        ids = self.cores.get(word)
        if ids is None:
            if len(self.cores) > self.cache_size:
                self.cores.clear()
            tokens = self.tokenizer.model.tokenize(word.encode().decode("latin-1").translate(self.mapped))
            ids = self.cores[word] = array("I", [t.id for t in tokens]).tobytes()
        return ids

    def _word(self, word: str) -> bytes:
        plain = _PLAIN(word)
        if plain:
            return self._core(plain[1]) + (self._core(plain[2]) if plain[2] else b"")
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> bytes:
        """Packed unsigned 32-bit ids of a text."""
        if _ODD_SPACE(text):  # Python takes these for white space, the vocabulary does not
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        try:
            text.encode("latin-1")
            words = text.lower().split()
        except UnicodeEncodeError:
            words = text.split()
        cache = self.cache
        try:
            return b"".join([cache[w] for w in words])
        except KeyError:
            if len(cache) > self.cache_size:
                cache.clear()
            for w in {w for w in words if w not in cache}:
                cache[w] = self._word(w)
        return b"".join([cache[w] for w in words])


_LOADED: dict[int, WordIds] = {}


def _load(source: str) -> WordIds:
    key = hash(source)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = WordIds(source)
    return _LOADED[key]


def pieces(docs: DataFrame, vocabulary: str, capacity: int, end_id: int = 0, doc_id: str = "doc_id", text: str = "text", rows_per_bucket: int = 50_000) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, bucket, nth``: every document's ids, cut only where longer than ``capacity``.

    ``nth`` numbers the pieces of a length within a ``bucket`` of one task. To be written before it is used twice.
    """
    with open(vocabulary, encoding="utf-8") as f:
        source = docs.sparkSession.sparkContext.broadcast(f.read())  # one vocabulary file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _load(source.value)
        end = array("I", [end_id]).tobytes()
        task, seen = TaskContext.get().partitionId() << 32, defaultdict(int)
        for batch in small_batches(batches, 2048):
            rows: list[list] = [[] for _ in range(7)]
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = words.encode(t or "") + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    length = len(part) // 4
                    block, nth = divmod(seen[length], rows_per_bucket)
                    seen[length] += 1
                    for column, value in zip(rows, (i, k, at // 4, length, zlib.crc32(part), task | block, nth), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows[0], batch.schema.field(0).type), pa.array(rows[1], pa.int32()), *[pa.array(r, pa.int64()) for r in rows[2:]]],
                ["doc_id", "piece", "start", "length", "ids_crc32", "bucket", "nth"],
            )

    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, bucket long, nth long")


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Slot runs ``(length, first rank, first bin, bins, copies a bin, offset)`` for a histogram of lengths.

    A run holds ``bins * copies`` pieces of its length, ``copies`` after one another in each bin.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    used: dict[int, int] = defaultdict(int)
    runs: list[tuple[int, int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}
    order: list[int] = []  # gap sizes that have bins, ascending
    n_bins = 0

    def put(length: int, first_bin: int, bins: int, copies: int, offset: int) -> None:
        runs.append((length, used[length], first_bin, bins, copies, offset))
        used[length] += bins * copies
        left[length] -= bins * copies

    def keep(gap: int, first_bin: int, bins: int) -> None:
        if gap and bins:
            if gap not in gaps:
                gaps[gap] = []
                bisect.insort(order, gap)
            gaps[gap].append((first_bin, bins))

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for n in large:
        for m in [m for m in large if m <= min(n, capacity - n)]:
            if not left[n]:
                break
            bins = left[n] // 2 if m == n else min(left[n], left[m])
            if bins:
                put(n, n_bins, bins, 1 if m != n else 2, 0)
                if m != n:
                    put(m, n_bins, bins, 1, n)
                keep(capacity - n - m, n_bins, bins)
                n_bins += bins
        if left[n]:
            keep(capacity - n, n_bins, left[n])
            n_bins += left[n]
            put(n, n_bins - left[n], left[n], 1, 0)
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            k = bisect.bisect_left(order, n)
            if k == len(order):
                copies = capacity // n
                bins = max(1, left[n] // copies)
                keep(capacity, n_bins, bins)
                n_bins += bins
                k = len(order) - 1
            gap = order[k]
            first, bins = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
                del order[k]
            copies = min(gap // n, left[n])
            fill = min(bins, left[n] // copies)
            put(n, first, fill, copies, capacity - gap)
            keep(gap - copies * n, first, fill)
            keep(gap, first + fill, bins - fill)
    return runs


def pack(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0, doc_id: str = "doc_id", text: str = "text", rows_per_bucket: int = 50_000) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece."""
    rows = cut(pieces(docs, vocabulary, capacity, end_id, doc_id, text, rows_per_bucket))
    counts = cut(rows.groupBy("length", "bucket").agg(F.count("*").alias("n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = np.array(plan(histogram, capacity), np.int64).reshape(-1, 6)
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    slots = docs.sparkSession.sparkContext.broadcast(runs)  # bounded by the capacity, not by the rows
    before = counts.select("length", "bucket", (F.sum("n").over(W.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("base"))
    ranked = rows.join(before, ["length", "bucket"]).withColumn("rank", F.col("base") + F.col("nth"))

    def look_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = slots.value
        keys = (table[:, 0] << 44) | table[:, 1]
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["rank"].to_numpy()
            run = table[np.searchsorted(keys, (length << 44) | rank, side="right") - 1]
            step = rank - run[:, 1]
            yield batch[["doc_id", "piece", "start", "length", "ids_crc32"]].assign(
                sequence_id=run[:, 2] + step // run[:, 4], offset=run[:, 5] + step % run[:, 4] * length
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInPandas(
        look_up, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
