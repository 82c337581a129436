"""Which texts hold which passages whole: a join on sampled substrings, verified last.

Both sides are cut into overlapping substrings of q bytes, hashed by a rolling
polynomial; of every w neighbouring ones the smallest hash is kept (minimizers). A text
that holds a passage of q + w - 1 bytes or more keeps all the minimizers that the passage
keeps, so no pair is missed. Passages that are shorter than that go by smaller q and w,
and those under 16 bytes by all substrings of their own length. A passage is looked up by
the one of its substrings that fewest texts have. Only hashes and ids are shuffled;
texts come in for the pairs left, and are compared whole.

Valid UTF-8 texts hold a passage exactly if their bytes do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.scratch import written

#: Classes of passages: (least bytes, q, w); under the last, q is the passage's length and every substring is kept.
CLASSES = [(47, 16, 32), (16, 8, 9)]
BASE = np.uint64(0x9E3779B97F4A7C15)


def hashes(raw: bytes, q: int) -> np.ndarray:
    """Hash of every substring of ``q`` bytes."""
    b = np.frombuffer(raw, np.uint8).astype(np.uint64) + np.uint64(1)
    n = len(b) - q + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    out, done, part, size = np.zeros(n, np.uint64), 0, b, 1
    while True:  # ``part`` has the sums over a power of two; those that make up q follow one another
        if q & size:
            out, done = out * np.uint64(pow(int(BASE), size, 1 << 64)) + part[done : done + n], done + size
        if done == q:
            break
        part, size = part[:-size] * np.uint64(pow(int(BASE), size, 1 << 64)) + part[size:], 2 * size
    return (out ^ (out >> np.uint64(31))) * BASE  # the minimum should not follow from the first bytes


def minimizers(raw: bytes, q: int, w: int) -> np.ndarray:
    """The distinct least hashes of every ``w`` neighbouring substrings; of fewer, of all."""
    h = hashes(raw, q)
    w, size = min(w, len(h)), 1
    while size < w:  # least of twice as many from two neighbours
        step = min(size, w - size)
        h, size = np.minimum(h[:-step], h[step:]), size + step
    return np.unique(h[np.append(True, h[1:] != h[:-1])]) if len(h) else h  # neighbours mostly share theirs


def class_of(n: int) -> tuple[int, int, int]:
    """Number, q and w of the class of a passage of ``n`` bytes."""
    for number, (least, q, w) in enumerate(CLASSES):
        if n >= least:
            return number, q, w
    return len(CLASSES) + n, n, 1


def _grams(rows: DataFrame, key: str, kinds: list[tuple[int, int, int]] | None) -> DataFrame:
    """``key, kind, gram`` of ``key, text``: of the text's own class, or of all the given ones."""
    id_type = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                at, kind, grams = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0, np.uint64)]
                for i, raw in enumerate(part.column(1).to_pylist()):
                    for number, q, w in kinds if kinds is not None else [class_of(len(raw))]:
                        found = minimizers(raw, q, w)
                        at.append(np.full(len(found), i))
                        kind.append(np.full(len(found), number, np.int32))
                        grams.append(found)
                columns = [part.column(0).take(pa.array(np.concatenate(at))), pa.array(np.concatenate(kind)), pa.array(np.concatenate(grams).view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, [key, "kind", "gram"])

    return rows.mapInArrow(run, f"{key} {id_type}, kind int, gram long")


def containing(texts: DataFrame, passages: DataFrame) -> DataFrame:
    """``query_id, chunk_id``: the texts (``chunk_id, body``) that hold a passage (``query_id, passage``).

    Null and empty passages, and null texts, are in no pair. Ids are distinct on either side.
    """
    asked = passages.where(F.octet_length("passage") > 0).select("query_id", "passage")
    held = texts.where("body IS NOT NULL").select("chunk_id", "body")
    own = written(_grams(asked.select("query_id", F.encode("passage", "UTF-8").alias("text")), "query_id", None))
    sizes = [r[0] for r in own.select("kind").distinct().collect()]  # one a class: at most 17
    kinds = [(k, *(CLASSES[k][1:] if k < len(CLASSES) else (k - len(CLASSES), 1))) for k in sorted(sizes)]
    places = _grams(held.select("chunk_id", F.encode("body", "UTF-8").alias("text")), "chunk_id", kinds)
    met = written(places.join(own.select("kind", "gram").distinct(), ["kind", "gram"], "left_semi"))
    counted = met.groupBy("kind", "gram").agg(F.count("*").alias("n"))
    # A substring that no text has ends the search for its passage, so the rarest is chosen among all.
    rare = W.partitionBy("query_id").orderBy("n", "gram")
    chosen = own.join(counted, ["kind", "gram"], "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("nth", F.row_number().over(rare)).where("nth = 1 AND n > 0")
    # Written, few pairs are known to be few, and texts come in without being dealt out.
    pairs = written(chosen.select("query_id", "kind", "gram").join(met, ["kind", "gram"]).select("query_id", "chunk_id"))
    return pairs.join(held, "chunk_id").join(asked, "query_id").where(F.contains("body", "passage")).select("query_id", "chunk_id")
