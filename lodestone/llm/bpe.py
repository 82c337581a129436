"""Byte-level BPE encoding and decoding by a dynamic program over prefixes.

A text is cut into pre-tokens by the vocabulary's pattern. Inside a pre-token,
every prefix has exactly one last token in its BPE encoding. An automaton over
the vocabulary lists the tokens that end at each place, longest first; the one
that is compatible with the last token of the prefix before it is stored.
Following these back-pointers from the end gives the exact ids, without merge
passes. Two tokens are compatible if plain merging of their joined bytes never
merges across the seam; that is decided by walking both tokens' edge pieces in
the order of merge ranks, and remembered.

Distinct words (runs between spaces) are encoded once per worker while they fit
a bounded cache.

Defined results: a null text counts as empty (no ids, empty decoding). The
string of a special token gives that token's id. Texts are processed whole.
Repeated rows are encoded one by one; other columns of the input stay out.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the pre-token pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NEVER = 1 << 60
WORD = "I"  # four bytes


def _byte_of_char() -> dict[str, int]:
    """The printable stand-in of every byte in the vocabulary file, inverted: printable Latin-1 stands for itself, the rest for U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """Encoder and decoder for one vocabulary; ``source`` is the text of its JSON file."""

    def __init__(self, source: str, cache_size: int = 500_000):
        data = json.loads(source)
        byte_of = _byte_of_char()
        raw = {token: bytes(byte_of[c] for c in token) for token in data["model"]["vocab"]}
        ids = data["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in data["added_tokens"]}
        size = 1 + max([*ids.values(), *self.special.values()])
        self.bytes_of: list[bytes] = [b""] * size
        for token, i in ids.items():
            self.bytes_of[i] = raw[token]
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.halves: dict[int, tuple[int, int, int]] = {}
        self.rank: dict[tuple[int, int], int] = {}
        for r, (left, right) in enumerate(data["model"]["merges"]):
            pair = (ids[left], ids[right])
            self.rank[pair] = r
            self.halves.setdefault(ids[left + right], (*pair, r))
        self.edges: tuple[dict, dict] = ({}, {})
        self.fits: dict[int, bool] = {}
        self.matches = ahocorasick.Automaton()
        for token, i in ids.items():
            if self._reachable(i):
                self.matches.add_word(raw[token].decode("latin-1"), (len(raw[token]), i))
        self.matches.make_automaton()
        self.split = regex.compile(PATTERN).findall
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.wide_gap = re.compile(r" \s").search
        self.cache: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.cache_size = cache_size
        self.lengths = np.array([len(b) for b in self.bytes_of])
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.pool = np.frombuffer(b"".join(self.bytes_of), np.uint8)

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The pieces that stand at one edge of a token while it is merged: (piece, rank of the merge that takes it up)."""
        known = self.edges[side].get(token)
        if known is None:
            pieces, piece, taken = [], token, NEVER
            while True:
                pieces.append((piece, taken))
                if piece not in self.halves:
                    break
                taken = self.halves[piece][2]
                piece = self.halves[piece][side]
            known = self.edges[side][token] = pieces[::-1]
        return known

    def _seam_holds(self, left: int, right: int, until: int = NEVER) -> bool:
        """Whether no merge of a rank below ``until`` crosses the seam between two tokens."""
        a, b = self._edge(left, 1), self._edge(right, 0)
        i = j = 0
        while True:
            (x, x_taken), (y, y_taken) = a[i], b[j]
            r = self.rank.get((x, y), NEVER)
            if r < x_taken and r <= y_taken and r < until:  # of equal pairs the leftmost merges first
                return False
            if x_taken == y_taken == NEVER:
                return True
            if x_taken <= y_taken:
                i += 1
            else:
                j += 1

    def _reachable(self, token: int) -> bool:
        """Whether merging a token's own bytes ends at the token."""
        stack = [token]
        while stack:
            t = stack.pop()
            if t in self.halves:
                left, right, r = self.halves[t]
                if not self._seam_holds(left, right, r):
                    return False
                stack += [left, right]
        return True

    def _piece(self, piece: str) -> list[int]:
        """Ids of one pre-token."""
        line = piece.encode().decode("latin-1")
        last: list[tuple[int, int]] = [(0, -1)] * (len(line) + 1)
        fits, done = self.fits, 0
        for end, (length, token) in self.matches.iter(line):
            end += 1
            if done == end:
                continue
            before = end - length
            if before:
                left = last[before][1]
                if left < 0:
                    continue
                key = left << 32 | token
                ok = fits.get(key)
                if ok is None:
                    if len(fits) > 2_000_000:
                        fits.clear()
                    ok = fits[key] = self._seam_holds(left, token)
                if not ok:
                    continue
            last[end] = (before, token)
            done = end
        ids, at = [], len(line)
        while at:
            at, token = last[at]
            ids.append(token)
        return ids[::-1]

    def _pieces(self, text: str) -> bytes:
        """Packed ids of a text, pre-token by pre-token."""
        known = self.pieces
        found = []
        for piece in self.split(text):
            ids = known.get(piece)
            if ids is None:
                ids = array(WORD, self._piece(piece)).tobytes()
                if len(piece) > 3:
                    if len(known) > self.cache_size // 2:
                        known.clear()
                    known[piece] = ids
            found.append(ids)
        return b"".join(found)

    def _plain(self, text: str) -> bytes:
        """Packed ids of a text without special tokens.

        A space that stands between two other white-space characters belongs to
        the pre-token of its run; every other space starts a new one, so that
        words cut at spaces can be looked up one by one.
        """
        if self.wide_gap(text):
            return self._pieces(text)
        first, *words = text.split(" ")
        cache = self.cache
        try:
            return self._pieces(first) + b"".join([cache[w] for w in words])
        except KeyError:
            if len(cache) > self.cache_size:
                cache.clear()
            for w in {w for w in words if w not in cache}:
                cache[w] = self._pieces(" " + w)
        return self._pieces(first) + b"".join([cache[w] for w in words])

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text, as unsigned 32-bit integers."""
        if self.at_special is None or not any(s in text for s in self.special):
            return np.frombuffer(self._plain(text), "<u4")
        parts = self.at_special.split(text)
        return np.frombuffer(
            b"".join(np.array([self.special[p]], "<u4").tobytes() if k % 2 else self._plain(p) for k, p in enumerate(parts)), "<u4"
        )

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """Joined bytes of the tokens."""
        n = self.lengths[ids]
        ends = np.cumsum(n)
        place = np.arange(ends[-1] if len(ids) else 0) + np.repeat(self.starts[ids] - (ends - n), n)
        return self.pool[place].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(ids).decode("utf-8", errors="replace")


_LOADED: dict[int, Bpe] = {}


def load(source: str) -> Bpe:
    """The worker's encoder for a vocabulary, built once."""
    key = hash(source)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Bpe(source)
    return _LOADED[key]


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches, so that no output of a slice gets large."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def encode_documents(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, ids, decoded`` of every row; ``vocabulary`` is the path of the JSON file, read on the driver and broadcast."""
    with open(vocabulary, encoding="utf-8") as f:
        source = docs.sparkSession.sparkContext.broadcast(f.read())  # one vocabulary file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(source.value)
        for batch in small_batches(batches):
            ids = [bpe.encode(t or "") for t in batch.column(1).to_pylist()]
            decoded = pa.array([bpe.decode(i) for i in ids], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), decoded], ["doc_id", "ids", "decoded"])

    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded string")


def digests(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row, without moving the ids out of the worker."""
    with open(vocabulary, encoding="utf-8") as f:
        source = docs.sparkSession.sparkContext.broadcast(f.read())  # one vocabulary file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(source.value)
        names = [str(i) for i in range(len(bpe.bytes_of))]
        for batch in small_batches(batches):
            counts, digest, decoded = [], [], []
            for t in batch.column(1).to_pylist():
                ids = bpe.encode(t or "")
                counts.append(len(ids))
                digest.append(hashlib.sha256(",".join([names[i] for i in ids.tolist()]).encode()).hexdigest())
                whole = bpe.decode(ids)
                decoded.append(hashlib.sha256(whole.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(digest), pa.array(decoded)],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
