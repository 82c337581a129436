"""Context packing, prompts and answers for batches of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions import text as T

#: Phrases by which an answer abstains.
ABSTAIN = [
    "i don't have enough information in the provided context",
    "i do not have enough information in the provided context",
    "insufficient information",
    "cannot answer",
    "no relevant information",
]
#: Section headers of the user prompt and the line for an empty context.
INDEX_HEADER, CONTEXT_HEADER, QUESTION_HEADER = "=== Source Index ===\n", "=== Context Passages ===\n", "=== Question ===\n"
NO_CONTEXT = "(No context passages available — please respond with the abstain message.)"
SYSTEM_PROMPT = "Answer only from the numbered context passages and cite each claim as [N]. If they do not hold the answer, say that you don't have enough information in the provided context."


def packing_tokens() -> Column:
    """A candidate's tokens: those counted, else the estimate for its text."""
    return F.when(F.col("token_count") > 0, F.col("token_count")).otherwise(T.token_estimate(F.col("display_text")))


def pack(candidates: DataFrame, top: int = 6, budget: int = 2048) -> DataFrame:
    """``query_id, ref_number, chunk_id, tokens, used_tokens, display_text, source_label``.

    In rank order, repeated texts are skipped; the first one that would exceed
    the budget ends the context. The choice is a prefix, so a running sum decides.
    """
    tokens = packing_tokens()
    ordered = W.partitionBy("query_id").orderBy("rank")
    first = F.row_number().over(W.partitionBy("query_id", F.sha2(T.strip(F.col("stable_text")), 256)).orderBy("rank"))
    unique = candidates.withColumns({"tokens": tokens, "nth": first}).where("nth = 1")
    summed = unique.withColumns({"ref_number": F.row_number().over(ordered), "used_tokens": F.sum("tokens").over(ordered)})
    chosen = summed.where((F.col("ref_number") <= top) & (F.col("used_tokens") <= budget))
    return chosen.select("query_id", "ref_number", "chunk_id", "tokens", "used_tokens", "display_text", "source_label")


def drop_reasons(candidates: DataFrame, top: int = 6, budget: int = 2048) -> DataFrame:
    """``query_id, chunk_id, rank, reason`` of candidates left out: duplicate, budget or below_top_k."""
    packed = pack(candidates, top, budget)
    first = F.row_number().over(W.partitionBy("query_id", F.sha2(T.strip(F.col("stable_text")), 256)).orderBy("rank"))
    marked = candidates.withColumn("nth", first)
    unique = marked.where("nth = 1").withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy("rank")))
    late = unique.select("query_id", "chunk_id", "place")
    out = marked.join(packed.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti").join(late, ["query_id", "chunk_id"], "left")
    reason = F.when(F.col("nth") > 1, "duplicate").when(F.col("place") > top, "below_top_k").otherwise("budget")
    return out.select("query_id", "chunk_id", "rank", reason.alias("reason"))


def packer_citations(packed: DataFrame, excerpt: int = 120) -> DataFrame:
    """``query_id, ref_number, chunk_id, source_label, excerpt`` of packed passages.

    Without a label it is the document's id (the chunk's, where there is none) and page; a longer text is cut and ends with an ellipsis.
    """
    name = F.col("doc_id" if "doc_id" in packed.columns else "chunk_id").cast("string")
    if "page" in packed.columns:
        name = F.when(F.col("page").isNotNull(), F.concat(name, F.lit(" — page "), F.col("page"))).otherwise(name)
    text = F.col("display_text")
    short = F.concat(F.regexp_replace(F.substring(text, 1, excerpt), f"{T.SPACE}+$", ""), F.lit("…"))
    return packed.select(
        "query_id",
        "ref_number",
        "chunk_id",
        F.coalesce(F.nullif("source_label", F.lit("")), name).alias("source_label"),
        F.when(F.char_length(text) > excerpt, short).otherwise(text).alias("excerpt"),
    )


def context_text(packed: DataFrame) -> DataFrame:
    """``query_id, context_text, total_tokens, n_passages``."""
    line = F.concat(F.lit("["), F.col("ref_number"), F.lit("] "), F.col("display_text"))
    rows = F.array_sort(F.collect_list(F.struct("ref_number", line.alias("line"))))
    return packed.groupBy("query_id").agg(
        F.array_join(rows["line"], "\n\n").alias("context_text"), F.sum("tokens").alias("total_tokens"), F.count("*").alias("n_passages")
    )


def prompts(queries: DataFrame, packed: DataFrame) -> DataFrame:
    """``query_id, system, user``: index of sources, passages or the abstain hint, then the question."""
    entry = F.concat(F.lit("["), F.col("ref_number"), F.lit("] "), F.col("source_label"))
    index = packed.groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("ref_number", entry.alias("line"))))["line"], "\n").alias("entries"))
    joined = queries.join(index, "query_id", "left").join(context_text(packed).select("query_id", "context_text"), "query_id", "left")
    user = F.concat_ws(
        "\n\n",
        F.when(F.col("entries").isNotNull(), F.concat(F.lit(INDEX_HEADER + "\n"), F.col("entries"))),
        F.concat(F.lit(CONTEXT_HEADER), F.coalesce("context_text", F.lit(NO_CONTEXT))),
        F.concat(F.lit(QUESTION_HEADER), T.strip(F.col("query"))),
    )
    return joined.select("query_id", F.lit(SYSTEM_PROMPT).alias("system"), user.alias("user"))


def abstained(answer: Column) -> Column:
    low = F.lower(answer)
    return F.exists(F.array(*[F.lit(p) for p in ABSTAIN]), lambda p: F.contains(low, p))


def cited_numbers(answer: Column) -> Column:
    """Distinct numbers in square brackets, in order."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit("\\[(\\d+)\\]"), F.lit(1)), lambda x: x.cast("int"))))


def cited_only(citations: DataFrame, answers: DataFrame) -> DataFrame:
    """Citations that the answer names; all of them where it names none."""
    named = answers.select("query_id", cited_numbers(F.col("answer")).alias("named"))
    joined = citations.join(named, "query_id")
    return joined.where((F.size("named") == 0) | F.array_contains("named", F.col("ref_number"))).drop("named")


def spans(answers: DataFrame) -> DataFrame:
    """``query_id, span_no, span_type, start, end, text``: alternating answer and citation_marker spans that cover the answer."""
    marked = F.regexp_replace("answer", "(\\[\\d+\\])", "\x1f$1\x1f")
    parts = F.filter(F.split(marked, "\x1f"), lambda x: x != "")
    rows = answers.select("query_id", F.posexplode(parts).alias("span_no", "text"))
    before = W.partitionBy("query_id").orderBy("span_no").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum(F.char_length("text")).over(before), F.lit(0)).cast("int"))
    kind = F.when(F.col("text").rlike("^\\[\\d+\\]$"), "citation_marker").otherwise("answer")
    return rows.select("query_id", "span_no", kind.alias("span_type"), "start", (F.col("start") + F.char_length("text")).alias("end"), "text")


def extractive_answers(packed: DataFrame) -> DataFrame:
    """``query_id, answer``: the first sentence of each passage with its number; the offline stand-in for a language model."""
    first = F.concat(F.coalesce(F.get(T.sentences(F.col("display_text")), F.lit(0)), F.lit("")), F.lit(" ["), F.col("ref_number"), F.lit("]"))
    rows = F.array_sort(F.collect_list(F.struct("ref_number", first.alias("line"))))
    return packed.groupBy("query_id").agg(F.array_join(rows["line"], " ").alias("answer"))
