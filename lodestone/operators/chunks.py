"""Anchors, chunk packing and rule-based enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions import text as T

#: Anchor rules in order: name, type, pattern on any line, level.
ANCHOR_RULES = [
    ("numbered_section", "section", "(?m)^\\d+(\\.\\d+)*\\.?\\s+\\S", 1),
    ("heading_h1", "heading", "(?m)^#\\s+\\S", 1),
    ("heading_h2", "heading", "(?m)^##\\s+\\S", 2),
    ("heading_h3", "heading", "(?m)^###\\s+\\S", 3),
    ("ordered_list", "list", "(?m)^\\d+\\.\\s+\\S", 1),
    ("unordered_list", "list", "(?m)^[-*•]\\s+\\S", 1),
    ("caps_title", "heading", "(?m)^[A-Z][A-Z\\s]{2,40}$", 2),
]
#: A word of ASCII letters alone in a lower-case text, and no part of a word or run with other characters.
PLAIN_WORD = "(?<![a-z0-9_\\x{80}-\\x{10FFFF}])(?:%s)(?![a-z0-9_\\x{80}-\\x{10FFFF}])"
#: Pronouns whose referent may lie outside of a chunk.
PRONOUNS = "it its itself this these that those they them their themselves he him his himself she her hers herself we us our ours ourselves".split()


def annotate(blocks: DataFrame) -> DataFrame:
    """``blocks`` with ``anchor_type``, ``anchor_level`` and ``rule_name`` of the first rule that holds, else ``none`` and 0."""
    text, nth = F.col("text"), F.lit(0)
    for i, (_, _, pattern, _) in reversed(list(enumerate(ANCHOR_RULES, 1))):
        nth = F.when(text.rlike(pattern), i).otherwise(nth)
    blocks = blocks.withColumn("nth_rule", nth)  # patterns are tried once, not for each column
    kind, level, rule = F.lit("none"), F.lit(0), F.lit(None).cast("string")
    for i, (name, anchor, _, depth) in enumerate(ANCHOR_RULES, 1):
        hit = F.col("nth_rule") == i
        kind, level, rule = F.when(hit, F.lit(anchor)).otherwise(kind), F.when(hit, F.lit(depth)).otherwise(level), F.when(hit, F.lit(name)).otherwise(rule)
    if "block_type" in blocks.columns:
        heading = F.col("block_type") == "heading"
        depth = F.when(text.startswith("###"), 3).when(text.startswith("##"), 2).otherwise(1)
        kind, level = F.when(heading, F.lit("heading")).otherwise(kind), F.when(heading, depth).otherwise(level)
        rule = F.when(heading, F.lit("block_type")).otherwise(rule)
    return blocks.withColumns({"anchor_type": kind, "anchor_level": level, "rule_name": rule}).drop("nth_rule")


def assign_chunks(blocks: DataFrame, token_budget: int = 512) -> DataFrame:
    """``blocks`` (annotated, with ``sequence`` and ``n_tokens``) with ``chunk_no``.

    A chunk ends before an anchor once it holds a block that is none, and before
    a block that would exceed the budget. Where a chunk that starts at a block would end
    follows from running sums, for every block at once; the starts that are met from the
    first block on are then found by doubling: with the first 2^t starts known, a jump of 2^t
    chunks from each gives as many again. So a document of n blocks takes n log n steps, and
    nothing grows along the way.
    """
    plain, none = F.col("anchor_type") == "none", (1 << 31) - 1
    ordered = W.partitionBy("doc_id").orderBy("sequence")
    back = W.partitionBy("doc_id").orderBy(F.desc("sequence"))
    placed = blocks.select("doc_id", "sequence", plain.alias("plain"), F.col("n_tokens").cast("long").alias("n_tokens")).withColumns(
        {"i": F.row_number().over(ordered) - 1, "upto": F.sum("n_tokens").over(ordered)}
    )
    placed = placed.withColumn("from", F.col("upto") - F.col("n_tokens"))
    # The last block that begins within the budget is the first that does not end in it, or the document's last.
    within = W.partitionBy("doc_id").orderBy("from").rangeBetween(0, token_budget)
    anchor_after = F.coalesce(F.min(F.when(~F.col("plain"), F.col("i"))).over(back.rowsBetween(W.unboundedPreceding, -1)), F.lit(none))
    placed = placed.withColumns({"last": F.max("i").over(within), "last_upto": F.max("upto").over(within), "anchor_after": anchor_after})
    stop = F.coalesce(F.last(F.when(F.col("plain"), F.col("anchor_after")), ignorenulls=True).over(back.rowsBetween(W.unboundedPreceding, 0)), F.lit(none))
    full = F.col("last") + (F.col("last_upto") <= F.col("from") + token_budget).cast("int")
    next_start = F.least(F.greatest(full, F.col("i") + 1), stop).alias("next")
    jumps = placed.select("doc_id", "sequence", next_start).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("sequence", "next"))).alias("r"))
    n = F.size("r")
    first = F.struct(F.array(F.lit(0)).alias("starts"), F.concat(F.col("r.next"), F.array(n)).alias("jump"))  # the end leads to itself

    def double(s: Column, _: Column) -> Column:
        jump = s["jump"]
        more = F.filter(F.transform(s["starts"], lambda i: F.get(jump, i)), lambda i: i < n)
        return F.struct(F.concat(s["starts"], more).alias("starts"), F.transform(jump, lambda i: F.get(jump, i)).alias("jump"))

    rounds = F.sequence(F.lit(1), F.ceil(F.log2(n + F.lit(1))).cast("int"))
    starts = jumps.select("doc_id", F.col("r.sequence").alias("sequences"), F.aggregate(rounds, first, double, lambda s: s["starts"]).alias("starts"))
    ends = starts.select("doc_id", "sequences", F.arrays_zip("starts", F.slice(F.concat("starts", F.array(F.size("sequences"))), 2, F.size("starts")).alias("ends")).alias("c"))
    chunk = ends.select("doc_id", F.posexplode("c").alias("chunk_no", "c"), "sequences")
    held = chunk.select("doc_id", "chunk_no", F.explode(F.slice("sequences", F.col("c.starts") + 1, F.col("c.ends") - F.col("c.starts"))).alias("sequence"))
    return blocks.join(held, ["doc_id", "sequence"])


def build_chunks(assigned: DataFrame) -> DataFrame:
    """``doc_id, chunk_no, chunk_id, stable_text, display_text, block_hashes, token_count, first_sequence, last_sequence``."""
    text, anchor = F.col("text"), F.col("anchor_type") != "none"
    so_far = W.partitionBy("doc_id", "chunk_no").orderBy("sequence").rowsBetween(W.unboundedPreceding, 0)
    heading = F.last(F.when(anchor, text), ignorenulls=True).over(so_far)
    parts = assigned.withColumns(
        {
            "stable": F.when(~anchor & heading.isNotNull(), F.concat(heading, F.lit(": "), text)).otherwise(text),
            "display": F.when(anchor, F.concat(F.lit("["), F.upper("anchor_type"), F.lit("] "), text)).otherwise(text),
        }
    )
    rows = F.array_sort(F.collect_list(F.struct("sequence", "stable", "display", "block_hash")))
    return (
        parts.groupBy("doc_id", "chunk_no")
        .agg(rows.alias("r"))
        .select(
            "doc_id",
            "chunk_no",
            T.chunk_signature(F.col("r.block_hash")).alias("chunk_id"),
            F.array_join("r.stable", "\n\n").alias("stable_text"),
            F.array_join("r.display", "\n\n").alias("display_text"),
            F.col("r.block_hash").alias("block_hashes"),
            F.element_at("r.sequence", 1).alias("first_sequence"),
            F.element_at("r.sequence", -1).alias("last_sequence"),
        )
        .withColumn("token_count", T.token_estimate(F.col("stable_text")))
    )


def pronouns(c: Column) -> tuple[Column, Column]:
    """Pronouns among the ASCII words of a text, and how many words these are."""
    return tuple(F.regexp_count(F.lower(c), F.lit(PLAIN_WORD % w)) for w in ("|".join(PRONOUNS), "[a-z]++"))


def _risk(hits: Column, n: Column) -> Column:
    return F.when(n < 5, F.lit(0.0)).otherwise(hits / n)


def pronoun_risk(c: Column) -> tuple[Column, Column, Column]:
    """Share of pronouns among the ASCII words of a text (0 under five words), pronouns and words."""
    hits, n = pronouns(c)
    return _risk(hits, n), F.when(n < 5, 0).otherwise(hits), n


def risk_level(score: Column) -> Column:
    return F.when(score < 0.2, "low").when(score < 0.5, "medium").otherwise("high")


def enrich(chunks: DataFrame, text: str = "stable_text", max_summary: int = 256, overwrite: bool = True) -> DataFrame:
    """``chunks`` with ``title``, ``summary``, ``tags``, ``pronoun_risk`` and ``risk_level``.

    Without ``overwrite`` values that are there and not empty stay.
    """
    if not overwrite:
        held = [c for c in ("title", "summary", "tags") if c in chunks.columns]
        renamed = chunks.withColumnsRenamed({c: f"__{c}" for c in held})
        made = enrich(renamed, text, max_summary)
        empty = lambda c: F.size(f"__{c}") == 0 if c == "tags" else F.trim(f"__{c}") == ""
        stays = {c: F.when(F.col(f"__{c}").isNotNull() & ~empty(c), F.col(f"__{c}")).otherwise(F.col(c)) for c in held}
        return made.withColumns(stays).drop(*[f"__{c}" for c in held])
    t = F.col(text)
    # What several columns need is made once for each row.
    heading = F.substring(T.strip(F.regexp_extract(t, "(?m)^#{1,6}\\s+(.+)", 1)), 1, 120)
    made = dict(zip(("heading", "sentences", "hits", "words"), (heading, T.sentences(t), *pronouns(t)), strict=True))
    chunks = chunks.select("*", F.explode(F.array(F.struct(*[c.alias(n) for n, c in made.items()]))).alias("__made"))
    heading, sentences, risk = F.col("__made.heading"), F.col("__made.sentences"), _risk(F.col("__made.hits"), F.col("__made.words"))
    short = F.get(F.filter(sentences, lambda s: F.char_length(s) <= 80), F.lit(0))
    start = F.replace(F.substring(T.strip(t), 1, 60), F.lit("\n"), F.lit(" "))
    tags = [
        F.when(t.rlike("```|`[^`]+`"), F.lit("has_code")),
        F.when(t.rlike("(?m)^\\|.+\\|"), F.lit("has_table")),
        F.when(t.rlike("(?m)^(\\s*[-*+]|\\s*\\d+\\.)\\s+"), F.lit("has_list")),
        F.when(risk >= 0.5, F.lit("high_pronoun_risk")),
    ]
    made = F.array_compact(F.array(*tags))
    if "section_path" in chunks.columns:
        made = F.concat(made, F.transform(F.coalesce("section_path", F.array().cast("array<string>")), lambda p: F.concat(F.lit("section:"), T.strip(p))))
    return chunks.withColumns(
        {
            "title": F.when(heading != "", heading).otherwise(F.coalesce(short, start)),
            "summary": F.substring(F.array_join(F.slice(sentences, 1, 2), " "), 1, max_summary),
            "tags": made,
            "pronoun_risk": F.round(risk, 6),
            "risk_level": risk_level(risk),
        }
    ).drop("__made")


def chunk_stats(chunks: DataFrame) -> DataFrame:
    n = F.col("token_count")
    return chunks.agg(
        F.count("*").alias("n_chunks"),
        F.count_distinct("doc_id").alias("n_docs"),
        F.round(F.avg(n), 6).alias("avg_tokens"),
        F.min(n).alias("min_tokens"),
        F.max(n).alias("max_tokens"),
    )


def token_histogram(chunks: DataFrame) -> DataFrame:
    n = F.col("token_count")
    bucket = F.when(n <= 128, "<=128").when(n <= 256, "<=256").when(n <= 384, "<=384").when(n <= 512, "<=512").otherwise(">512")
    return chunks.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n_chunks"))
