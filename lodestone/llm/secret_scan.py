"""Secrets in texts: three base patterns, and high-entropy stretches found by sliding windows.

Base patterns (``BASE``) are matched from left to right, without overlaps within
a kind; matches that are too short are dropped. Beside them, every candidate
string, a maximal run of characters of a class, is walked by a window of fixed
width. The window's character counts are kept up to date, one character in and
one out a step, and with them the sum of c log2 c that its Shannon entropy needs
(in integers, so no step adds an error). Windows that reach the class's threshold
and hold the kinds of character it asks for are secret; those that overlap are one
span. An allow-list of patterns over the candidate (identifiers, alphabets, placeholders)
or over what stands before it (digests named as such, addresses) suppresses such
spans; it never touches the base patterns.

Texts are read where they lie, without a shuffle. A batch is screened by one
linear pattern first, so only texts with a possible finding are walked in Python.

Defined results: a null or empty text has no spans. Positions are code points,
ends exclusive, over the whole text. Repeated rows are scanned one by one; other
columns of the input stay out; an empty table gives an empty one.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.bpe import small_batches

#: Fixed values of the base: kind, pattern, the group that is measured, its least length.
BASE = [
    ("assign", r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
]


class CharacterClass(NamedTuple):
    """A class of candidate strings: their characters, the window's width, its least entropy in bits, and kinds that it must hold."""

    name: str
    characters: str
    width: int
    bits: float
    needs: tuple[str, ...]


#: A window of 24 random characters has about 3.5 bits with 16 different ones, 4.0 with 36 and 4.3 with 64; joined words stay below 3.9.
CLASSES = [
    CharacterClass("hex", "0-9A-Fa-f", 24, 3.0, ("[0-9]", "[A-Fa-f]")),
    CharacterClass("alnum", "0-9A-Za-z", 24, 3.7, ("[0-9]", "[A-Za-z]")),
    CharacterClass("base64", "0-9A-Za-z+/_=-", 24, 3.9, ("[0-9]", "[a-z]", "[A-Z]")),
]
#: Searched in the candidate itself.
ALLOWED = [
    r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}",  # a UUID
    r"(?i)example|sample|dummy|placeholder|your[_-]?(?:key|token|secret)",
    r"(?i)^sha(?:1|224|256|384|512)[-=]",  # a digest said to be one
    r"(?i)abcdefgh|0123456789",  # an alphabet
]
#: Searched in up to 40 characters of the line before it.
NAMED = [
    r"(?i)\bsha(?:1|224|256|384|512)[-:=]\s*$",
    r"(?i)\b(?:commit|revision|checksum|integrity|etag)\b\W{0,4}\w*$",
    r"(?i);base64,$",  # embedded data
    r"(?i)https?:\S*$",  # a path of an address
]
CONTEXT = 40
#: Fixed point of the sums, in parts of a bit.
UNIT = 1 << 40


def windows(run: str, width: int, bits: float) -> Iterator[tuple[int, float]]:
    """Start and entropy of each window of ``run`` with at least ``bits`` bits, by incremental counts."""
    term = [0] + [round(c * math.log2(c) * UNIT) for c in range(1, width + 1)]
    most = round((math.log2(width) - bits) * width * UNIT)  # sum of c log2 c at the threshold
    counts: dict[str, int] = {}
    total = 0
    for end, char in enumerate(run):
        c = counts.get(char, 0)
        total += term[c + 1] - term[c]
        counts[char] = c + 1
        start = end - width + 1
        if start < 0:
            continue
        if total <= most:
            yield start, math.log2(width) - total / UNIT / width
        c = counts[run[start]]
        total += term[c - 1] - term[c]
        counts[run[start]] = c - 1


def entropy_spans(text: str, classes: list[CharacterClass] = CLASSES, allowed: list[str] = ALLOWED, named: list[str] = NAMED) -> list[tuple[int, int, float]]:
    """Start, end and highest entropy of the stretches over secret windows of any class, sorted, joined where they overlap."""
    found: list[tuple[int, int, float]] = []
    for kind in classes:
        needs = [re.compile(n) for n in kind.needs]
        for candidate in re.finditer(f"[{kind.characters}]{{{kind.width},}}", text):
            run, at = candidate[0], candidate.start()
            if not all(n.search(run) for n in needs):
                continue
            line = text.rfind("\n", max(0, at - CONTEXT), at) + 1
            before = text[max(line, at - CONTEXT) : at]
            if any(re.search(a, run) for a in allowed) or any(re.search(a, before) for a in named):
                continue
            for start, entropy in windows(run, kind.width, kind.bits):
                if all(n.search(run, start, start + kind.width) for n in needs):
                    found.append((at + start, at + start + kind.width, entropy))
    joined: list[tuple[int, int, float]] = []
    for start, end, entropy in sorted(found):
        if joined and start < joined[-1][1]:
            joined[-1] = (joined[-1][0], max(end, joined[-1][1]), max(entropy, joined[-1][2]))
        else:
            joined.append((start, end, entropy))
    return joined


def spans_of(text: str, classes: list[CharacterClass] = CLASSES, allowed: list[str] = ALLOWED, named: list[str] = NAMED) -> list[tuple[str, int, int, float | None]]:
    """``kind, start, end, bits`` by start, then kind as listed; entropy spans inside a base span are left to that."""
    order = {kind: i for i, (kind, *_) in enumerate(BASE)}
    base = [(kind, m.start(), m.end(), None) for kind, pattern, group, least in BASE for m in re.finditer(pattern, text) if m.end(group) - m.start(group) >= least]
    own = [("entropy", a, b, e) for a, b, e in entropy_spans(text, classes, allowed, named) if not any(x[1] <= a and b <= x[2] for x in base)]
    return sorted(base + own, key=lambda x: (x[1], order.get(x[0], len(order))))


def screen(classes: list[CharacterClass]) -> str:
    """A pattern that every text with a finding matches."""
    runs = [f"[{c.characters}]{{{c.width}}}" for c in classes]
    return "|".join([r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]""", "AKIA[A-Z0-9]{16}", "[0-9a-f]{24}", *runs])


def scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", classes: list[CharacterClass] = CLASSES, allowed: list[str] = ALLOWED, named: list[str] = NAMED) -> DataFrame:
    """``doc_id, spans``: for every row an array of ``kind, start, end, bits``, sorted."""
    pattern = screen(classes)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("bits", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            likely = pc.match_substring_regex(batch.column(1), pattern).to_pylist()
            spans = [[dict(zip(("kind", "start", "end", "bits"), s, strict=True)) for s in spans_of(batch.column(1)[i].as_py(), classes, allowed, named)] if hit else [] for i, hit in enumerate(likely)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], ["doc_id", "spans"])

    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    id_type = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(run, f"doc_id {id_type}, spans array<struct<kind:string,start:bigint,end:bigint,bits:double>>")


def count_of(spans: Column, kind: str) -> Column:
    """Number of spans of a kind."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def joined(spans: Column) -> Column:
    """``kind:start:end`` of the spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def base_only(spans: Column) -> Column:
    """The spans of the base patterns."""
    return F.filter(spans, lambda s: s["kind"].isin([kind for kind, *_ in BASE]))


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with each span, joined where they overlap, replaced by ``mark``."""
    empty = F.struct(F.lit("").alias("done"), F.lit(0).cast("bigint").alias("at"))

    def step(state: Column, span: Column) -> Column:
        between = F.substr(text, (state["at"] + 1).cast("int"), F.greatest(span["start"] - state["at"], F.lit(0)).cast("int"))
        fresh = F.when(span["start"] >= state["at"], F.concat(state["done"], between, F.lit(mark))).otherwise(state["done"])
        return F.struct(fresh.alias("done"), F.greatest(state["at"], span["end"]).alias("at"))

    return F.aggregate(spans, empty, step, lambda s: F.concat(s["done"], F.substr(text, (s["at"] + 1).cast("int"))))
