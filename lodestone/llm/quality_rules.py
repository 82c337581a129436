"""Quality rules as a bitmask ledger, in DataFrame functions only.

Every rule is evaluated once per document; what it measured and whether it
failed are stored (``failed_bits``, bit *i* for ``RULES[i]``). A policy is a
versioned mask over the ledger, and an ablation is an aggregation of its bits,
so neither reads a text again.

Defined results: a null or empty text has no words, so it fails ``few_words``
only. All measures are over the whole text. Columns of the input with the name
of a measure are replaced. Repeated rows are measured one by one; an empty
table gives an empty ledger.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = "[\\x20\\x09-\\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

#: Rule name and the SQL condition under which it fails; the place in the list is the bit.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 50"),
    ("repeated_phrases", "100 * n_repeat_words > 50 * n_words"),
    ("many_symbols", "10 * n_symbols > 3 * n_words AND n_words > 0"),
    ("word_length", "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 14 * n_words)"),
    ("repeated_lines", "n_lines >= 4 AND 10 * n_dup_lines > 6 * n_lines"),
    ("shouting", "n_letters > 0 AND 10 * n_upper > 6 * n_letters"),
]
#: Versioned policies: the rules that reject.
POLICIES: dict[str, list[str]] = {
    "base": ["few_words", "repeated_phrases"],
    "v1": ["few_words", "repeated_phrases", "many_symbols", "word_length", "repeated_lines", "shouting"],
}
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper"]


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), use)[0]


def _octets_without(text: Column, chars: str) -> Column:
    for char in chars:
        text = F.replace(text, F.lit(char), F.lit(""))
    return F.octet_length(text)


def _repeat_words(words: Column) -> Column:
    """Words inside a window of three words that the text holds at least twice, the first time included.

    Windows are compared by a 64-bit hash of their three words; equal hashes are
    brought together by sorting (hash, place), so the work grows as n log n.
    """

    def covered(ordered: Column) -> Column:
        size = F.size(ordered)
        again = F.filter(
            ordered,
            lambda x, i: ((i > 0) & (F.get(ordered, i - 1)["h"] == x["h"]))
            | ((i < size - 1) & (F.get(ordered, i + 1)["h"] == x["h"])),
        )
        places = F.flatten(F.transform(again, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))
        return F.size(F.array_distinct(places))

    def windows(ws: Column) -> Column:
        return F.transform(
            F.slice(ws, 1, F.greatest(F.size(ws) - 2, F.lit(0))),
            lambda w, i: F.xxhash64(w, F.get(ws, i + 1), F.get(ws, i + 2)),
        )

    def ranked(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(_let(pairs, covered))

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(_let(windows(words), ranked))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the measures as long columns."""
    whole = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(whole, SPACE), lambda w: w != "")
    lines = F.filter(F.split(whole, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    held = docs.drop(*MEASURES).withColumns({"__words": words, "__lines": lines})
    octets = F.octet_length(whole)
    joined = F.array_join("__words", "")
    small = F.regexp_count(whole, F.lit("\\p{Ll}"))
    upper = F.regexp_count(whole, F.lit("\\p{Lu}"))
    measures = {
        "n_words": F.size("__words"),
        "word_chars": F.char_length(joined),
        "n_symbols": octets - _octets_without(whole, SYMBOLS),
        "n_dup_lines": F.size("__lines") - F.size(F.array_distinct("__lines")),
        "n_repeat_words": _repeat_words(F.col("__words")),
        "n_lines": F.size("__lines"),
        "n_letters": small + upper,
        "n_upper": upper,
    }
    # A filter on a measure stops at the generator; pushed below, it would compute all measures anew for each use.
    once = F.explode(F.array(F.struct(*[c.cast("long").alias(n) for n, c in measures.items()])))
    return held.select("*", once.alias("__m")).select("*", "__m.*").drop("__words", "__lines", "__m")


def mask(names: list[str]) -> int:
    """The bits of the named rules."""
    at = {name: i for i, (name, _) in enumerate(RULES)}
    return sum(1 << at[name] for name in names)


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with measures and ``failed_bits``."""
    measured = measure(docs, text)
    bits = F.lit(0).cast("long")
    for i, (_, condition) in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(F.expr(condition), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return measured.withColumn("failed_bits", bits)


def apply_policy(scored: DataFrame, version: str = "v1") -> DataFrame:
    """``scored`` (a ledger) with ``base_failed`` and ``kept`` under the named policy."""
    failed = lambda names: F.col("failed_bits").bitwiseAND(F.lit(mask(names)).cast("long")) != 0
    return scored.withColumns({"base_failed": failed(POLICIES["base"]), "kept": ~failed(POLICIES[version])})


def ablation(scored: DataFrame, version: str = "v1") -> DataFrame:
    """Per rule of a policy: documents that fail it, that fail it alone, and that would be kept without it."""
    whole = mask(POLICIES[version])
    rows = F.array(
        *[F.struct(F.lit(n).alias("rule"), F.lit(mask([n])).cast("long").alias("bit")) for n in POLICIES[version]]
    )
    bits = F.col("failed_bits").bitwiseAND(F.lit(whole).cast("long"))
    return (
        scored.select(bits.alias("bits"), F.explode(rows).alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.count_if(F.col("bits").bitwiseAND(F.col("r.bit")) != 0).alias("n_failed"),
            F.count_if(F.col("bits") == F.col("r.bit")).alias("n_failed_alone"),
            F.count_if(F.col("bits").bitwiseAND(F.bitwise_not("r.bit")) == 0).alias("n_kept_without"),
        )
    )
