"""Registered queries over the operators: name to ``(spark, sf_dir) -> DataFrame``.

A line of ``documents`` is a block, ten lines are a page, ``lang`` is a document's
collection, ``benchmark`` holds the queries, and ``vec_id`` names the document
with that ``doc_id`` as well as a vector.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import blocks, chunks, clean, contain, context, fusion, identity, keyword, metrics, models, parse, trace, vectors
from lodestone.operators.store import Store
from lodestone.oracles import ORACLE_SQL  # noqa: F401
from lodestone.plans.engine import CLEANING, Engine
from lodestone.scratch import shared_folder, spread, written
from lodestone.sources import page_tree, threads, web

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.line_blocks(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


def _split(spark: SparkSession, sf_dir: str, max_tokens: int = 512) -> DataFrame:
    return blocks.split_blocks(_lines(spark, sf_dir), max_tokens)


def _digest(c: str):
    return F.sha2(F.col(c), 256)


# Blocks and identity


@query
def blocks_split(spark, sf_dir):
    return _split(spark, sf_dir, 64).select("doc_id", "sequence", "block_hash", "n_tokens")


@query
def doc_fingerprint(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    content = T.fingerprint(F.col("text"))
    return docs.select("doc_id", content.alias("fingerprint"), T.document_key(F.col("source"), content).alias("doc_key"))


@query
def parse_metrics(spark, sf_dir):
    return blocks.document_metrics(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


@query
def quality_gates(spark, sf_dir):
    gated = blocks.quality_gates(blocks.document_metrics(table(spark, sf_dir, "documents")))
    return gated.select("doc_id", F.array_join("reasons", ",").alias("reasons"), "passed")


@query
def sentence_split(spark, sf_dir):
    held = _lines(spark, sf_dir).select("doc_id", "pos", F.posexplode(T.sentences(F.col("text"))).alias("nth", "sentence"))
    return held.select("doc_id", "pos", "nth", _digest("sentence").alias("sentence_hash"))


# Cleaning


@query
def clean_unicode(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.col("text"), F.lit(" … “é” ﬁn — é")).alias("text"))
    return clean.unicode_fix(docs).select("doc_id", _digest("text").alias("text_hash"))


@query
def clean_empty(spark, sf_dir):
    return clean.drop_empty(_lines(spark, sf_dir), 3).select("doc_id", "pos")


@query
def clean_pipeline(spark, sf_dir):
    """The engine's cleaning steps in turn, over every line."""
    return clean.clean(_lines(spark, sf_dir), CLEANING).select("doc_id", "pos", _digest("text").alias("text_hash"))


@query
def clean_ocr_merge(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return clean.merge_ocr_lines(docs).select("doc_id", _digest("text").alias("text_hash"))


@query
def clean_navigation(spark, sf_dir):
    return clean.drop_navigation(_lines(spark, sf_dir)).select("doc_id", "pos")


@query
def clean_page_navigation(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), web.main_text(F.col("html")).alias("text"))
    return clean.drop_navigation(blocks.line_blocks(pages)).select("doc_id", "pos", _digest("text").alias("text_hash"))


@query
def clean_repeated_headers(spark, sf_dir):
    paged = _lines(spark, sf_dir).withColumn("page", F.floor(F.col("pos") / 10).cast("int"))
    return clean.drop_repeated_headers(paged).select("doc_id", "pos")


@query
def clean_dedupe_lines(spark, sf_dir):
    return clean.dedupe_document_lines(table(spark, sf_dir, "documents")).select("doc_id", "pos")


# Sniffing, routing, parsing


@query
def sniff_types(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    named = pages.select("page_id", web.canonical_name(F.col("url")).alias("name"), F.encode("html", "UTF-8").alias("content"))
    return named.select("page_id", parse.sniff(F.col("content"), F.col("name")).alias("s")).select("page_id", "s.detected_type", "s.mime_type", "s.confidence", "s.strategy")


@query
def route_types(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    sniffed = pages.select("page_id", parse.sniff(F.encode("html", "UTF-8"), web.canonical_name(F.col("url"))).alias("s")).select("page_id", "s.detected_type")
    return parse.route(sniffed).select("page_id", F.array_join("candidates", ",").alias("candidates"), "unsupported")


@query
def markdown_blocks(spark, sf_dir):
    return parse.markdown_blocks(_markdown(spark, sf_dir)).select(
        "doc_id", "pos", "block_type", _digest("text").alias("text_hash"), F.array_join(F.transform("section_path", T.block_hash), ",").alias("section")
    )


def _markdown(spark, sf_dir):
    """Documents as markdown: by a line's place a heading, a fence, a blank line or text."""
    i, line = F.col("pos"), F.col("text")
    marked = (
        F.when(i % 9 == 0, F.concat(F.lit("# "), line))
        .when(i % 9 == 4, F.concat(F.lit("## "), line))
        .when(i % 9 == 6, F.lit("```"))
        .when(i % 9 == 8, F.lit(""))
        .otherwise(line)
    )
    lines = _lines(spark, sf_dir).select("doc_id", "pos", marked.alias("line"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "line")))
    return lines.groupBy("doc_id").agg(F.array_join(ordered["line"], "\n").alias("text"))


@query
def html_main_text(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", web.main_text(F.col("html")).alias("text")).select("page_id", F.char_length("text").alias("n_chars"), _digest("text").alias("text_hash"))


@query
def html_tree_text(spark, sf_dir):
    """Main text by the densities of the tag tree."""
    made = page_tree.extract(table(spark, sf_dir, "pages").select("page_id", "html"))
    return made.select("page_id", F.char_length("text").cast("long").alias("n_chars"), _digest("text").alias("text_hash"))


@query
def url_canonical(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id", web.raw_url(url).alias("raw_url"), web.canonical_name(url).alias("name"), web.extension(url).alias("extension")
    )


@query
def web_artifacts(spark, sf_dir):
    """The stored pages as fetched ones: what is not empty, with its name, type and text."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.col("html").cast("binary").alias("content"), F.lit(None).cast("string").alias("error"))
    return web.artifacts(pages).select("page_id", "source_id", "file_name", "mime_type", _digest("content_text").alias("text_hash"))


@query
def thread_flatten(spark, sf_dir):
    flat = threads.flatten(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    return flat.select("conv_id", "n_messages", "cursor", _digest("text").alias("text_hash"))


# Anchors, chunks, enrichment


def _annotated(spark, sf_dir, prefixed: bool = True):
    """Split blocks, with list and heading marks put before some by their place."""
    held = _split(spark, sf_dir)
    if prefixed:
        i = F.col("sequence")
        mark = F.when(i % 7 == 0, "# ").when(i % 7 == 3, "2.1 ").when(i % 11 == 5, "- ").otherwise("")
        held = held.withColumn("text", F.concat(mark, F.col("text")))
        held = held.withColumns({"block_hash": T.block_hash(F.col("text")), "n_tokens": T.token_estimate(F.col("text"))})
    return chunks.annotate(held)


def _chunks(spark, sf_dir):
    return chunks.build_chunks(chunks.assign_chunks(_annotated(spark, sf_dir), 256))


@query
def anchor_annotate(spark, sf_dir):
    return _annotated(spark, sf_dir).select("doc_id", "sequence", "anchor_type", "anchor_level", "rule_name")


@query
def chunk_pack(spark, sf_dir):
    assigned = chunks.assign_chunks(_annotated(spark, sf_dir), 256)
    return assigned.select("doc_id", "sequence", "chunk_no")


@query
def chunk_build(spark, sf_dir):
    return _chunks(spark, sf_dir).select(
        "doc_id", "chunk_no", "chunk_id", _digest("stable_text").alias("stable_hash"), _digest("display_text").alias("display_hash"), "token_count", "first_sequence", "last_sequence"
    )


@query
def chunk_stats(spark, sf_dir):
    return chunks.chunk_stats(_chunks(spark, sf_dir))


@query
def chunk_token_histogram(spark, sf_dir):
    return chunks.token_histogram(_chunks(spark, sf_dir))


@query
def pronoun_risk(spark, sf_dir):
    score, hits, words = chunks.pronoun_risk(F.col("text"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.round(score, 6).alias("score"), hits.alias("pronouns"), words.alias("words"), chunks.risk_level(score).alias("level")
    )


@query
def enrich_chunks(spark, sf_dir):
    rich = chunks.enrich(_chunks(spark, sf_dir))
    return rich.select("doc_id", "chunk_no", _digest("title").alias("title_hash"), _digest("summary").alias("summary_hash"), F.array_join("tags", ",").alias("tags"))


# Incremental work: the second version drops every tenth line and alters every seventh


def _versions(spark, sf_dir):
    old = blocks.split_blocks(_lines(spark, sf_dir)).select("doc_id", F.col("sequence").alias("pos"), "text", "block_hash")
    turn = F.col("doc_id") + F.col("pos")
    changed = F.when(turn % 7 == 0, F.concat(F.col("text"), F.lit(" x"))).otherwise(F.col("text"))
    new = old.where(turn % 10 != 0).withColumn("text", changed).withColumn("block_hash", T.block_hash(F.col("text")))
    return old, new


@query
def block_diff(spark, sf_dir):
    old, new = _versions(spark, sf_dir)
    return identity.diff_blocks(old, new, ["doc_id"]).groupBy("doc_id", "block_hash", "status").agg(F.count("*").alias("n"))


@query
def diff_guardrail(spark, sf_dir):
    old, new = _versions(spark, sf_dir)
    return identity.guardrail(identity.diff_blocks(old, new, ["doc_id"]), ["doc_id"])


def _signed(spark, sf_dir):
    return [v.select("doc_id", "pos", F.col("block_hash").alias("chunk_signature")) for v in _versions(spark, sf_dir)]


@query
def resync_window(spark, sf_dir):
    old, new = _signed(spark, sf_dir)
    return identity.resync(old, new, window=1)


@query
def resync_hybrid(spark, sf_dir):
    old, new = _signed(spark, sf_dir)
    return identity.resync_stats(identity.resync(old, new, window=1, fallback=0.8))


@query
def stale_chunks(spark, sf_dir):
    old, new = _signed(spark, sf_dir)
    return identity.stale_chunks(old, new, ["doc_id", "chunk_signature"]).select("doc_id", "pos", "chunk_signature")


@query
def early_skip(spark, sf_dir):
    """All documents against the version before, in which every seventh text was another."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    former = F.when(F.col("doc_id") % 7 == 0, F.concat(F.col("text"), F.lit(" x"))).otherwise(F.col("text"))
    known = docs.select(T.fingerprint(former).alias("doc_key"))
    return identity.early_skip(docs.select("doc_id", T.fingerprint(F.col("text")).alias("doc_key")), known).select("doc_id", "doc_key")


@query
def latest_version(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("source_path"), F.col("n_chars").alias("ingest_seq"))
    return identity.latest_version(docs)


@query
def upsert_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    rows = docs.where("doc_id % 5 = 0").withColumn("doc_id", F.col("doc_id") * 2).withColumn("n_chars", F.lit(-1).cast("long"))
    return identity.upsert(docs, rows, ["doc_id"])


@query
def delete_documents(spark, sf_dir):
    gone = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    held = identity.delete_documents({"documents": table(spark, sf_dir, "documents"), "blocks": _lines(spark, sf_dir)}, gone)
    return held["blocks"].groupBy("doc_id").agg(F.count("*").alias("n_blocks")).join(held["documents"].select("doc_id"), "doc_id")


# Retrieval


def _corpus(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("chunk_id"), F.col("text").alias("stable_text"), F.col("text").alias("display_text"), F.col("source").alias("source_path"), "lang", T.token_estimate(F.col("text")).alias("token_count")
    )


def _asked(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _index(spark, sf_dir):
    return keyword.build(spread(_corpus(spark, sf_dir).select("chunk_id", "stable_text")))


def _keyword(spark, sf_dir, k: int = 20):
    return keyword.search(_index(spark, sf_dir), _asked(spark, sf_dir), k)


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", "label")


def _vector_list(spark, sf_dir, k: int = 20):
    """Nearest vectors of the vector whose id is a query's number."""
    asked = _vectors(spark, sf_dir).select(F.col("chunk_id").alias("query_id"), "embedding").join(_asked(spark, sf_dir).select("query_id"), "query_id", "left_semi")
    near = vectors.search(_vectors(spark, sf_dir), asked, k)
    return near.select("query_id", "chunk_id", (-F.col("l2sq")).alias("vector_score"), "rank")


def _hybrid(spark, sf_dir, top: int = 10):
    # Written, the few rows chosen are known to be few, and texts are looked up without dealing all documents out.
    fused = written(fusion.rrf({"bm25": _keyword(spark, sf_dir), "vector": _vector_list(spark, sf_dir)}, top=top))
    return fused.join(_corpus(spark, sf_dir), "chunk_id").join(_asked(spark, sf_dir), "query_id")


@query
def bm25_statistics(spark, sf_dir):
    index = _index(spark, sf_dir)
    return index.statistics.select("term", "df", F.round("idf", 6).alias("idf"))


@query
def bm25_topk(spark, sf_dir):
    return _keyword(spark, sf_dir, 10)


@query
def bm25_pruned(spark, sf_dir):
    """The same by way of a stored index: its blocks give thresholds, and a pass over its chunks skips what cannot reach them."""
    index = _index(spark, sf_dir)
    stored = keyword.KeywordIndex(index.forward, index.terms, index.corpus, written(keyword.term_blocks(index.forward)))
    return keyword.search(stored, _asked(spark, sf_dir), 10)


@query
def bm25_filled(spark, sf_dir):
    """Names of sources as queries; few texts hold one, so chunks at score zero follow."""
    asked = table(spark, sf_dir, "documents").where("source IS NOT NULL").groupBy(F.col("source").alias("query")).agg(F.min("doc_id").alias("query_id"))
    return keyword.search(_index(spark, sf_dir), asked, 10, fill=True)


@query
def bm25_topk_collection(spark, sf_dir):
    scope = _corpus(spark, sf_dir).where("lang = 'en'").select("chunk_id")
    return keyword.search(_index(spark, sf_dir), _asked(spark, sf_dir), 10, scope)


@query
def keyword_remove(spark, sf_dir):
    index = _index(spark, sf_dir)
    gone = _corpus(spark, sf_dir).where("chunk_id % 4 = 0").select("chunk_id")
    return keyword.remove(index, gone).statistics.select("term", "df", F.round("idf", 6).alias("idf"))


def _every_hundredth(spark, sf_dir):
    return _vectors(spark, sf_dir).where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), "embedding", "label")


@query
def knn_topk(spark, sf_dir):
    return vectors.search(_vectors(spark, sf_dir), _every_hundredth(spark, sf_dir), 10)


@query
def knn_pivots(spark, sf_dir):
    """The same in blocks of 256, so that cells around pivots and their bounds decide what a query meets."""
    return vectors.search(_vectors(spark, sf_dir), _every_hundredth(spark, sf_dir), 10, block=256)


@query
def knn_topk_filtered(spark, sf_dir):
    return vectors.search(_vectors(spark, sf_dir), _every_hundredth(spark, sf_dir), 10, same="label")


@query
def vector_dimensions(spark, sf_dir):
    return vectors.dimensions(vectors.checked(_vectors(spark, sf_dir)))


@query
def attribute_candidates(spark, sf_dir):
    merged = fusion.attribute(_keyword(spark, sf_dir), _vector_list(spark, sf_dir))
    return merged.withColumn("source_label", fusion.source_label(F.col("bm25_score"), F.col("vector_score"), F.col("retrieval_source")))


@query
def rrf_fusion(spark, sf_dir):
    return fusion.rrf({"bm25": _keyword(spark, sf_dir), "vector": _vector_list(spark, sf_dir)}, top=10)


@query
def hybrid_search(spark, sf_dir):
    kept = fusion.language_filter(_hybrid(spark, sf_dir))
    ranked = fusion.rerank_noop(kept, 10)
    return ranked.select("query_id", "chunk_id", "rank", "rrf_score", "final_score", "retrieval_source", "source_path")


@query
def language_filter(spark, sf_dir):
    """Every third query in Chinese, every fifth document with a Chinese word."""
    rows = _hybrid(spark, sf_dir).withColumn("query", F.when(F.col("query_id") % 3 == 0, F.concat(F.lit("查询 "), F.col("query"))).otherwise(F.col("query")))
    rows = rows.withColumn("stable_text", F.when(F.col("chunk_id") % 5 == 0, F.concat(F.lit("文 "), F.col("stable_text"))).otherwise(F.col("stable_text")))
    return fusion.language_filter(rows).select("query_id", "chunk_id", "rank")


@query
def rerank_overlap(spark, sf_dir):
    ranked = fusion.build_reranker("overlap")(_hybrid(spark, sf_dir), 5)
    return ranked.select("query_id", "chunk_id", "rank", "rerank_score")


@query
def rank_change(spark, sf_dir):
    before = _hybrid(spark, sf_dir)
    return fusion.rank_change(before, fusion.build_reranker("overlap")(before, 5))


@query
def citations(spark, sf_dir):
    rows = fusion.citations(_hybrid(spark, sf_dir))
    return rows.select("query_id", "ref_number", "chunk_id", "source_label", _digest("excerpt").alias("excerpt_hash"))


# Context and answers


def _pack(rows):
    return context.pack(rows.withColumn("source_label", F.col("source_path")), 6, 2048)


def _packed(spark, sf_dir):
    """Packed passages, written, so that what several uses need is searched once."""
    return written(_pack(_hybrid(spark, sf_dir)))


@query
def context_pack(spark, sf_dir):
    return _packed(spark, sf_dir).select("query_id", "ref_number", "chunk_id", "tokens", "used_tokens")


@query
def packer_citations(spark, sf_dir):
    """Every third packed passage without a label."""
    packed = _packed(spark, sf_dir).withColumn("source_label", F.when(F.col("chunk_id") % 3 != 0, F.col("source_label")))
    return context.packer_citations(packed).select("query_id", "ref_number", "chunk_id", "source_label", _digest("excerpt").alias("excerpt_hash"))


@query
def context_drop_reasons(spark, sf_dir):
    return context.drop_reasons(_hybrid(spark, sf_dir).withColumn("source_label", F.col("source_path")), 6, 2048)


@query
def context_text(spark, sf_dir):
    made = context.context_text(_packed(spark, sf_dir))
    return made.select("query_id", _digest("context_text").alias("context_hash"), "total_tokens", "n_passages")


@query
def prompt_build(spark, sf_dir):
    made = context.prompts(_asked(spark, sf_dir), _packed(spark, sf_dir))
    return made.select("query_id", _digest("user").alias("user_hash"))


def _answers(packed):
    """Extracted answers; every fourth abstains and every fifth cites its first passage only."""
    made = context.extractive_answers(packed)
    q = F.col("query_id")
    refusal = F.lit("Sorry, I don't have enough information in the provided context to answer this question.")
    return made.withColumn("answer", F.when(q % 4 == 0, refusal).when(q % 5 == 0, F.regexp_replace("answer", "\\[[2-9]\\]", "")).otherwise(F.col("answer")))


@query
def abstain_detection(spark, sf_dir):
    return _answers(_packed(spark, sf_dir)).select("query_id", context.abstained(F.col("answer")).alias("abstained"))


@query
def cited_filter(spark, sf_dir):
    packed = _packed(spark, sf_dir)
    return context.cited_only(packed.select("query_id", "ref_number", "chunk_id"), _answers(packed))


@query
def answer_spans(spark, sf_dir):
    made = context.spans(_answers(_packed(spark, sf_dir)))
    return made.select("query_id", "span_no", "span_type", F.col("start").alias("start_at"), F.col("end").alias("end_at"), _digest("text").alias("text_hash"))


# Evaluation


def _qrels(spark, sf_dir):
    """Documents that hold a benchmark passage whole."""
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("passage"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("body"))
    return contain.containing(spread(docs), asked)


@query
def eval_per_query(spark, sf_dir):
    return metrics.per_query(_keyword(spark, sf_dir), _qrels(spark, sf_dir), 10)


@query
def eval_macro(spark, sf_dir):
    return metrics.macro(metrics.per_query(_keyword(spark, sf_dir), _qrels(spark, sf_dir), 10))


@query
def benchmark_report(spark, sf_dir):
    """Documents as a judged corpus in a stored index: means at 10 of the best 100, and where candidates come from."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.coalesce("text", F.lit("")).alias("stable_text"))
    engine = Engine(spark, Store(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"))
    _, report = engine.run_benchmark({"chunks": docs, "queries": _asked(spark, sf_dir), "qrels": written(_qrels(spark, sf_dir))})
    return report.select("n_queries", "recall", "mrr", "ndcg", "attribution.total", "attribution.n_bm25_only")


@query
def eval_answerable(spark, sf_dir):
    """Means without the queries that are to be declined, here every fourth."""
    behaviour = F.when(F.col("item_id") % 4 == 0, "abstain").otherwise("answer").alias("expected_behavior")
    cases = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), behaviour)
    rows = metrics.per_query(_keyword(spark, sf_dir), _qrels(spark, sf_dir), 10)
    return metrics.macro(metrics.answerable(rows, cases))


@query
def case_outcomes(spark, sf_dir):
    return metrics.outcomes(metrics.per_query(_keyword(spark, sf_dir), _qrels(spark, sf_dir), 10))


@query
def source_attribution(spark, sf_dir):
    rows = _hybrid(spark, sf_dir)
    label = fusion.source_label(F.col("bm25_score"), F.col("vector_score"), F.col("retrieval_source"))
    return metrics.source_attribution(rows.withColumn("source_label", label))


@query
def token_saved(spark, sf_dir):
    rows = written(_hybrid(spark, sf_dir))
    return metrics.token_saving(_pack(rows), rows)


@query
def baseline_compare(spark, sf_dir):
    row = metrics.macro(metrics.per_query(_keyword(spark, sf_dir), _qrels(spark, sf_dir), 10))
    return metrics.baseline_comparison(row, {"scifact": 0.665, "fiqa": 0.236, "nfcorpus": 0.325})


@query
def latency_mean_p95(spark, sf_dir):
    return metrics.latency(table(spark, sf_dir, "events"), "value", ["event_type"])


# Run log and collections


@query
def runs_latest(spark, sf_dir):
    events = table(spark, sf_dir, "events").where("event_type = 'purchase'")
    return events.orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select("event_id", "user_id", "event_type")


@query
def runs_by_type(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n_runs"), F.max("event_id").alias("last_id"), F.count_distinct("user_id").alias("n_users"))


@query
def list_collections(spark, sf_dir):
    name = F.coalesce(F.nullif("lang", F.lit("")), F.lit("default"))
    return table(spark, sf_dir, "documents").groupBy(name.alias("collection")).agg(F.count("*").alias("n_documents"))


@query
def ingest_summary(spark, sf_dir):
    return metrics.ingest_summary(blocks.quality_gates(blocks.document_metrics(table(spark, sf_dir, "documents"))))


@query
def sync_counters(spark, sf_dir):
    flat = threads.flatten(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    return threads.sync_counters(flat, known=flat.where("conv_id % 3 = 0").select("conv_id"), key="conv_id")


@query
def connector_cursor(spark, sf_dir):
    talks = table(spark, sf_dir, "conversations")
    return threads.since(talks, "turn", 1).groupBy("role").agg(F.count("*").alias("n_new"), F.max("turn").alias("cursor"))


@query
def extractive_answers(spark, sf_dir):
    return _answers(_packed(spark, sf_dir)).select("query_id", _digest("answer").alias("answer_hash"))


@query
def answer_quality(spark, sf_dir):
    """Extracted answers against the whole passage as the expected answer."""
    packed = _packed(spark, sf_dir)
    made = context.context_text(packed).select("query_id", F.col("context_text").alias("context"))
    expected = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("expected"))
    rows = _answers(packed).join(made, "query_id").join(expected, "query_id").join(_asked(spark, sf_dir), "query_id")
    return models.answer_quality(rows).select("query_id", "faithfulness", "answer_relevancy", "context_recall")


@query
def layout_headings(spark, sf_dir):
    """Lines as text spans: halves of a line, every sixth line in a larger size."""
    lines = _lines(spark, sf_dir)
    half = F.floor(F.char_length("text") / 2).cast("int")
    parts = F.array(F.struct(F.lit(0).alias("span"), F.substring(F.col("text"), F.lit(1), half).alias("text")), F.struct(F.lit(1).alias("span"), F.substring(F.col("text"), half + 1, F.char_length("text")).alias("text")))
    spans = lines.select("doc_id", F.floor(F.col("pos") / 10).cast("int").alias("page"), F.col("pos").alias("line"), F.when(F.col("pos") % 6 == 0, 14.0).otherwise(10.0).alias("size"), F.explode(parts).alias("s"))
    found = parse.pdf_headings(spans.select("doc_id", "page", "line", "size", "s.span", "s.text"))
    return found.select("doc_id", "page", "line", "block_type")


@query
def layout_paragraphs(spark, sf_dir):
    """Lines as text spans in several layout blocks a page, every sixth line in a larger size."""
    lines = _lines(spark, sf_dir)
    place = {"page": F.floor(F.col("pos") / 10), "block": F.floor(F.col("pos") % 10 / 4)}
    size = F.when(F.col("pos") % 6 == 0, 14.0).otherwise(10.0).alias("size")
    spans = lines.select("doc_id", *[c.cast("int").alias(n) for n, c in place.items()], F.col("pos").alias("line"), F.lit(0).alias("span"), size, "text")
    found = parse.layout_blocks(spans)
    return found.select("doc_id", "page", "block", "first_line", "n_lines", "block_type", _digest("text").alias("text_hash"))


@query
def hash_embedding_neighbours(spark, sf_dir):
    """Nearest documents of every hundredth one by hashed term counts."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    rows = models.embed_texts(docs, models.hash_vectors, "text").select("chunk_id", "embedding")
    asked = rows.where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), "embedding")
    return vectors.search(rows, asked, 5)


@query
def trace_stages(spark, sf_dir):
    """The event log as a trace: each type of event stands for a stage."""
    kinds = {"view": "retrieve", "click": "rerank", "purchase": "generate"}
    stage = F.lit("parse")
    for kind, name in kinds.items():
        stage = F.when(F.col("event_type") == kind, name).otherwise(stage)
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), stage.alias("stage"), F.col("value").alias("latency_ms"))
    return trace.by_stage(events).select("run_id", "stage", "n_events", F.round("latency_ms", 4).alias("latency_ms"))


@query
def trace_latest(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), "event_id", "event_type", F.col("ts").alias("created_at"))
    return trace.latest_event(events, "click").select("run_id", "event_id")
