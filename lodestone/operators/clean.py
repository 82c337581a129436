"""Block cleaning steps, each ``DataFrame -> DataFrame`` over ``doc_id, pos, text``."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lodestone.functions import text as T

#: Typographic characters and their plain forms.
PLAIN_FORMS = {
    "‘": "'",
    "’": "'",
    "“": '"',
    "”": '"',
    "–": "-",
    "—": "--",
    "…": "...",
    " ": " ",
    "­": "",
    "ﬁ": "fi",
    "ﬂ": "fl",
    "ﬀ": "ff",
    "ﬃ": "ffi",
    "ﬄ": "ffl",
}
#: Phrases of navigation and footers.
NAV_PHRASES = [
    "skip to content",
    "skip to main",
    "back to top",
    "privacy policy",
    "terms of service",
    "terms and conditions",
    "cookie policy",
    "all rights reserved",
    "copyright ©",
    "© ",
    "site map",
    "sitemap",
    "contact us",
    "subscribe to our newsletter",
    "follow us on",
    "share this page",
    "breadcrumb",
]
#: Characters that part the entries of a navigation bar.
NAV_SEPARATORS = ["|", "•", "·", "–", "—", "/"]


@F.pandas_udf(StringType())
def nfc(texts: pd.Series) -> pd.Series:
    """Canonical composition, which Spark has no function for."""
    return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


nfc = nfc.asNondeterministic()  # it is not, but else later filters are pushed below it with a second call of their own


def plain_characters(c: Column) -> Column:
    for fancy, plain in PLAIN_FORMS.items():
        c = F.replace(c, F.lit(fancy), F.lit(plain))
    return c


def unicode_fix(blocks: DataFrame) -> DataFrame:
    """Composed, with plain forms. Only texts with characters from U+0300 on can change under composition."""
    open_ = F.col("text").rlike("[\\x{0300}-\\x{10FFFF}]")
    composed = F.coalesce(nfc(F.when(open_, F.col("text"))), F.col("text"))  # other texts do not go to Python
    return blocks.withColumn("text", plain_characters(composed))


def drop_empty(blocks: DataFrame, min_chars: int = 1) -> DataFrame:
    return blocks.where(F.char_length(T.strip(F.col("text"))) >= min_chars)


def merged_lines(c: Column, short: int = 80) -> Column:
    """Lines joined up to one that ends a sentence or is not short; blank lines end a run and go."""
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def add(state: Column, line: Column) -> Column:
        grown = F.when(state["open"] == "", line).otherwise(F.concat(state["open"], F.lit(" "), line))
        full = line.rlike("[.!?\"']$") | (F.char_length(line) >= short)
        flush = (line == "") & (state["open"] != "")
        done = F.when(flush, F.concat(state["done"], F.array(state["open"]))).when((line != "") & full, F.concat(state["done"], F.array(grown)))
        return F.struct(
            F.coalesce(done, state["done"]).alias("done"),
            F.when((line == "") | full, F.lit("")).otherwise(grown).alias("open"),
        )

    lines = F.transform(F.split(c, "\n"), T.strip)
    merged = F.aggregate(
        lines, empty, add, lambda s: F.array_join(F.when(s["open"] != "", F.concat(s["done"], F.array(s["open"]))).otherwise(s["done"]), "\n")
    )
    return F.when(F.contains(c, F.lit("\n")), merged).otherwise(c)


def merge_ocr_lines(blocks: DataFrame, short: int = 80) -> DataFrame:
    return blocks.withColumn("text", merged_lines(F.col("text"), short))


def is_navigation(c: Column) -> Column:
    """A navigation phrase, or 2 to 10 short entries between one kind of separator."""
    low = F.lower(c)
    phrase = F.exists(F.array(*[F.lit(p) for p in NAV_PHRASES]), lambda p: F.contains(low, p))

    def listed(separator: str) -> Column:
        parts = F.filter(F.transform(F.split(c, f"[{separator}]"), T.strip), lambda x: x != "")
        short = F.forall(parts, lambda x: F.char_length(x) <= 30)
        return F.contains(c, F.lit(separator)) & F.size(parts).between(2, 10) & short

    found = phrase
    for separator in NAV_SEPARATORS:
        found = found | listed(separator)
    return found


def drop_navigation(blocks: DataFrame) -> DataFrame:
    once = F.transform(F.array(T.strip(F.col("text"))), is_navigation)[0]  # strips each text once
    return blocks.where(~once)


def drop_repeated_headers(blocks: DataFrame, share: float = 0.5) -> DataFrame:
    """Drops texts on more than ``share`` of a document's pages, where it has two pages or more. Needs ``page``."""
    stripped = blocks.withColumn("line", T.strip(F.col("text")))
    pages = stripped.groupBy("doc_id").agg(F.count_distinct("page").alias("pages"))
    often = (
        stripped.where("page IS NOT NULL")
        .groupBy("doc_id", "line")
        .agg(F.count_distinct("page").alias("on_pages"))
        .join(pages, "doc_id")
        .where((F.col("pages") >= 2) & (F.col("on_pages") > share * F.col("pages")))
    )
    return stripped.join(often, ["doc_id", "line"], "left_anti").drop("line")


def dedupe_paragraphs(blocks: DataFrame) -> DataFrame:
    """First of equal stripped texts in each document."""
    order = W.partitionBy("doc_id", F.sha2(T.strip(F.col("text")), 256)).orderBy("pos")
    return blocks.withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")


def dedupe_document_lines(docs: DataFrame) -> DataFrame:
    """``doc_id, pos, text``: what :func:`dedupe_paragraphs` keeps of the lines of ``doc_id, text``, within each row: no shuffle."""
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x, i: F.struct(T.strip(x).alias("line"), i.alias("pos"), x.alias("text")))

    def first(ordered: Column) -> Column:
        return F.filter(ordered, lambda x, i: (i == 0) | (F.get(ordered, i - 1)["line"] != x["line"]))

    kept = F.transform(F.array(F.array_sort(lines)), first)[0]  # sorted once: equal lines lie side by side, the first place before
    return docs.select("doc_id", F.explode(kept).alias("k")).select("doc_id", "k.pos", "k.text")


STEPS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "unicode_fix": unicode_fix,
    "empty_filter": drop_empty,
    "ocr_line_merge": merge_ocr_lines,
    "html_nav_footer_remove": drop_navigation,
    "pdf_header_footer_dedupe": drop_repeated_headers,
    "dedupe_paragraphs": dedupe_paragraphs,
}


def clean(blocks: DataFrame, steps: Iterable[str]) -> DataFrame:
    """The named steps in order."""
    for name in steps:
        if name not in STEPS:
            raise ValueError(f"unknown cleaning step: {name}")
        blocks = blocks.transform(STEPS[name])
    return blocks
