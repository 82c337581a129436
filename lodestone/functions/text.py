"""Column functions on text: white space, tokens, sentences, hashes.

Patterns are the same in Java and RE2, so every function has a plain SQL twin.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as ``str.split`` and ``str.strip`` see it.
SPACE = "[\\x{09}-\\x{0D}\\x{1C}-\\x{20}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"
#: The same characters one by one.
SPACES = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
WORD = "[\\p{L}\\p{N}_]+"
CJK = "[\\x{4E00}-\\x{9FFF}\\x{3400}-\\x{4DBF}]"


def strip(c: Column) -> Column:
    """Without white space at either end."""
    return F.btrim(c, F.lit(SPACES))


def canonical(c: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, f"{SPACE}+", " "))


def block_hash(c: Column) -> Column:
    return F.sha2(canonical(c), 256)


def chunk_signature(hashes: Column) -> Column:
    return F.sha2(F.array_join(hashes, "|"), 256)


def fingerprint(content: Column) -> Column:
    return F.sha2(content, 256)


def document_key(source_path: Column, content_fingerprint: Column) -> Column:
    return F.sha2(F.concat_ws(":", source_path, content_fingerprint), 256)


def token_estimate(c: Column) -> Column:
    """A quarter of the code points, one at least."""
    return F.greatest(F.lit(1), F.floor(F.char_length(c) / 4)).cast("int")


def has_cjk(c: Column) -> Column:
    return c.rlike(CJK)


def terms(c: Column) -> Column:
    """Index terms: lower-case words; texts with CJK characters yield single characters other than white space."""
    words = F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))
    characters = F.filter(F.split(c, ""), lambda x: (x != "") & ~x.rlike(SPACE))
    return F.when(has_cjk(c), characters).otherwise(words)


def sentences(c: Column) -> Column:
    """Parts after . ! ? and white space, or after CJK full stops; stripped, empty ones dropped."""
    marked = F.regexp_replace(F.regexp_replace(c, f"([.!?]){SPACE}+", "$1\x1f"), "([\\x{3002}\\x{FF01}\\x{FF1F}])", "$1\x1f")
    return F.filter(F.transform(F.split(marked, "\x1f"), strip), lambda x: x != "")


def non_printable(c: Column) -> Column:
    """Characters that are neither printable nor line ends or tabs."""
    return F.regexp_count(F.translate(c, "\n\r\t ", ""), F.lit("[\\p{C}\\p{Z}]"))


def pack_greedily(items: Column, size, limit: int, separator: str) -> Column:
    """Joins neighbours while their sizes stay within ``limit``; an oversized item stands alone."""
    empty = F.struct(
        F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("open"), F.lit(0).alias("used")
    )

    def add(state: Column, item: Column) -> Column:
        n = size(item)
        full = (F.size(state["open"]) > 0) & (state["used"] + n > limit)
        return F.struct(
            F.when(full, F.concat(state["done"], F.array(F.array_join(state["open"], separator)))).otherwise(state["done"]).alias("done"),
            F.when(full, F.array(item)).otherwise(F.concat(state["open"], F.array(item))).alias("open"),
            F.when(full, n).otherwise(state["used"] + n).cast("int").alias("used"),
        )

    def close(state: Column) -> Column:
        last = F.when(F.size(state["open"]) > 0, F.array(F.array_join(state["open"], separator)))
        return F.concat(state["done"], F.coalesce(last, F.array().cast("array<string>")))

    return F.aggregate(items, empty, add, close)
