"""Token counts by section, attributed through offsets of the whole document's encoding.

A document is encoded once, as a whole, so counts are those a model sees. Its
tokens' spans are joined to the spans of its sections as intervals (both lie
inside one row, in order, so the join is a binary search and no token leaves its
worker). A token that crosses a boundary belongs to the section that holds its
first byte; ``n_crossing`` counts those a section gained that way.

Sections are the lines of a text with their line ends, by default, or spans
given in a column ``array<struct<name:string,start:bigint,end:bigint>>`` of
code points, sorted and not overlapping; tokens outside of all spans are counted
under the section name ``(rest)``.

Defined results: a null or empty text has one section, empty, with no token.
A null list of sections means the lines; null sections, and sections without a
start or an end, are left out; without any left, all tokens are ``(rest)``.
Repeated rows are counted one by one. Other columns of the input stay out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.bpe import load, small_batches


def line_starts(raw: bytes) -> np.ndarray:
    """Byte offset of every line; the text's last line end opens no line."""
    ends = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10) + 1
    return np.concatenate(([0], ends[ends < len(raw)]))


def attribute(lengths: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and boundary-crossing tokens of each section; the last place counts tokens outside all.

    ``lengths`` are the tokens' bytes in order, ``starts`` and ``ends`` the sections' byte spans.
    """
    token_end = np.cumsum(lengths)
    token_start = token_end - lengths
    at = np.searchsorted(starts, token_start, side="right") - 1
    outside = (at < 0) | (token_start >= ends[at])
    at = np.where(outside, len(starts), at)
    reach = np.append(ends, np.iinfo(np.int64).max)[at]
    n = len(starts) + 1
    return np.bincount(at, minlength=n), np.bincount(at[token_end > reach], minlength=n)


def count_tokens(docs: DataFrame, vocabulary: str, sections: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, section, name, start, end, n_tokens, n_crossing``: a row for each section, spans in code points."""
    with open(vocabulary, encoding="utf-8") as f:
        source = docs.sparkSession.sparkContext.broadcast(f.read())  # one vocabulary file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(source.value)
        for batch in small_batches(batches):
            parts: list[tuple] = []
            ids_of, names = [], []
            for k, t in enumerate(batch.column(1).to_pylist()):
                raw = (t or "").encode()
                chars = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))
                lengths = bpe.lengths[bpe.encode(t or "")]
                given = batch.column(2)[k].as_py() if sections else None
                if given is None:
                    starts = line_starts(raw)
                    ends = np.append(starts[1:], len(raw))
                    own = [None] * len(starts)
                else:
                    given = [s for s in given if s is not None and s["start"] is not None and s["end"] is not None]
                    byte_at = np.searchsorted(chars, np.array([[s["start"], s["end"]] for s in given], np.int64).reshape(-1, 2), side="right") - 1
                    starts, ends = (byte_at[:, 0], byte_at[:, 1]) if len(given) else (np.array([0]), np.array([0]))
                    own = [s["name"] for s in given] or [None]
                n, crossing = attribute(lengths, starts, ends)
                if n[-1]:
                    starts, ends, own = np.append(starts, 0), np.append(ends, len(raw)), [*own, "(rest)"]
                m = len(starts)
                ids_of += [k] * m
                names += own
                parts.append((np.arange(m), chars[starts], chars[ends], n[:m], crossing[:m]))
            columns = [pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*parts, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(ids_of, pa.int64())), columns[0], pa.array(names, pa.string()), *columns[1:]],
                ["doc_id", "section", "name", "start", "end", "n_tokens", "n_crossing"],
            )

    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), *([F.col(sections)] if sections else []))
    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(run, f"doc_id {kind}, section long, name string, start long, end long, n_tokens long, n_crossing long")
