"""The engine: ingest, search, answer and evaluate as DataFrames of many documents or queries at once.

An ingest writes each table's new rows once, as segments that nobody sees, reads what
follows from these, and makes them all visible with one manifest. A search takes one
snapshot, so its index, scope and texts are of the same commit.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import blocks, chunks, clean, context, fusion, identity, keyword, metrics, models, trace, vectors
from lodestone.operators.models import Complete, Embed
from lodestone.operators.store import Segment, Snapshot, Store
from lodestone.scratch import counted, written
from lodestone.sources import files, threads



def together(*work: Callable) -> list:
    """What the functions return; their jobs run side by side."""
    with ThreadPoolExecutor(len(work)) as pool:
        return [f.result() for f in [pool.submit(w) for w in work]]


#: Tables that follow from the chunks alone.
INDEX = ("forward", "terms", "corpus", "blocks_of_terms", "gone", "vectors")
CLEANING = ("unicode_fix", "empty_filter", "ocr_line_merge", "html_nav_footer_remove", "dedupe_paragraphs")


def _within(name: str, value: int, low: int, high: int) -> int:
    if not low <= value <= high:
        raise ValueError(f"{name} must lie between {low} and {high}")
    return value


@dataclass
class Engine:
    spark: SparkSession
    store: Store
    token_budget: int = 512
    top_k: int = 10
    context_top_k: int = 6
    context_budget: int = 2048
    embed: Embed | None = None  # texts to vectors, called in batches in the workers
    complete: Complete | None = None  # prompts to answers, called in batches in the workers

    def __post_init__(self) -> None:
        _within("token_budget", self.token_budget, 64, 4096)
        _within("top_k", self.top_k, 1, 100)
        _within("context_top_k", self.context_top_k, 1, 20)
        self.store.merges |= {"terms": keyword.merge_terms, "places": lambda rows: rows.where("live"), "corpus": lambda rows: rows.agg(F.sum("chunks").alias("chunks"), F.sum("n_terms").alias("n_terms"))}

    def _keyed(self, documents: DataFrame) -> DataFrame:
        if "collection" not in documents.columns:
            documents = documents.withColumn("collection", F.lit("default"))
        key = T.document_key(F.col("source_path"), T.fingerprint(F.coalesce("text", F.lit(""))))
        return documents.select(key.alias("doc_id"), F.col("source_path").cast("string"), F.col("text").cast("string"), F.col("collection").cast("string"))

    def _split(self, keyed: DataFrame) -> DataFrame:
        return blocks.split_blocks(clean.clean(blocks.line_blocks(keyed), CLEANING), self.token_budget)

    def _chunks(self, split: DataFrame, keyed: DataFrame) -> DataFrame:
        built = chunks.build_chunks(chunks.assign_chunks(chunks.annotate(split), self.token_budget))
        named = built.join(keyed.select("doc_id", "source_path", F.coalesce("collection", F.lit("default")).alias("collection")), "doc_id")
        return chunks.enrich(named)

    def prepare(self, documents: DataFrame) -> dict[str, DataFrame]:
        """Blocks and chunks of ``source_path, text, collection``; one line is one block."""
        keyed = self._keyed(documents)
        split = self._split(keyed)
        return {"documents": keyed, "blocks": split, "chunks": self._chunks(split, keyed)}

    def ingest(self, documents: DataFrame, more: tuple[Segment, ...] = ()) -> DataFrame:
        """Stores new and changed documents and removes what their former versions no longer hold, in one commit.

        Returns ``doc_id, source_path, n_blocks, n_chunks, blocks_unchanged, blocks_added, blocks_removed, level`` of what was
        ingested. Segments in ``more`` become visible with it.
        """
        held, store = self.store.snapshot(), self.store
        keyed = self._keyed(documents)
        known = held.read("documents")
        docs = store.stage("documents", keyed if known is None else identity.early_skip(keyed, known.select("doc_id"), "doc_id").select(keyed.columns), ingested_at=F.current_timestamp())
        split = store.stage("blocks", self._split(docs.rows))
        made = store.stage("chunks", self._chunks(split.rows, docs.rows))
        place = ["chunk_id", "doc_id", "source_path", "collection"]
        places = made.rows.select(*place, F.lit(True).alias("live"))
        removed, former = [], None
        if known is not None:
            paths = docs.rows.select("source_path").distinct()
            former = written(known.select("doc_id", "source_path").join(paths, "source_path", "left_semi").join(docs.rows.select("doc_id"), "doc_id", "left_anti"))
            removed = store.stage_removals(["documents", "blocks", "chunks"], former)
            places = places.unionByName(held.of("chunks", former).select(*place, F.lit(False).alias("live")))
        placed, out, index = together(
            lambda: store.stage("places", places),
            lambda: written(self._changes(held, docs.rows, split.rows, made.rows, former)),
            lambda: self._index_changes(held, made.rows, former),
        )
        store.commit([*removed, *index[0], docs, split, made, placed, *index[1], *more])
        return out

    def _changes(self, held: Snapshot, docs: DataFrame, split: DataFrame, made: DataFrame, former: DataFrame | None) -> DataFrame:
        out = docs.select("doc_id", "source_path").join(split.groupBy("doc_id").agg(F.count("*").alias("n_blocks")), "doc_id", "left")
        out = out.join(made.groupBy("doc_id").agg(F.count("*").alias("n_chunks")), "doc_id", "left")
        marks = [f"blocks_{s}" for s in ("unchanged", "added", "removed")]
        if former is None:
            return out.withColumns({**{m: F.lit(None).cast("long") for m in marks}, "level": F.lit("none")})
        before = held.of("blocks", former).join(former, "doc_id").select("source_path", "block_hash")
        after = split.join(docs.select("doc_id", "source_path"), "doc_id").select("source_path", "block_hash")
        counted = identity.guardrail(identity.diff_blocks(before, after, ["source_path"]), ["source_path"])
        named = counted.select("source_path", *[F.col(m.removeprefix("blocks_")).alias(m) for m in marks], "level")
        return out.join(named, "source_path", "left").select("doc_id", "source_path", "n_blocks", "n_chunks", *marks, "level")

    def _index_changes(self, held: Snapshot, made: DataFrame, former: DataFrame | None) -> tuple[list[Segment], list[Segment]]:
        """Removals and additions that bring the index from a snapshot to its chunks with ``made`` and without those of ``former`` only.

        Only new chunks are tokenized and embedded. A chunk is its content, so it stays as long as any document has it.
        """
        store = self.store
        ids = made.select("chunk_id").distinct()
        # Texts are dealt out only where ids repeat, which the ids alone tell.
        repeated = not made.groupBy("chunk_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
        texts = made.dropDuplicates(["chunk_id"]) if repeated else made
        gone = None
        if held.exists("forward"):
            texts = texts.join(held.of("forward", ids).select("chunk_id"), "chunk_id", "left_anti")
            lost = held.of("chunks", former).select("chunk_id", "doc_id")
            elsewhere = held.of("places", lost).where("live").join(former, "doc_id", "left_anti").select("chunk_id")
            gone = written(lost.select("chunk_id").distinct().join(elsewhere.unionByName(ids), "chunk_id", "left_anti"))
        forward = store.stage("forward", keyword.term_counts(texts), distinct=True)
        counted = keyword.count_chunks(forward.rows)
        again = None
        if gone is not None:
            lost_rows = held.of("forward", gone)
            none = {"max_tf": F.lit(None).cast("long"), "min_terms": F.lit(None).cast("int"), "df": -F.col("df")}
            lost_terms = keyword.count_terms(lost_rows).withColumns(none)
            less = keyword.count_chunks(lost_rows)
            counted = counted.unionByName(less.select((-F.col("chunks")).alias("chunks"), (-F.col("n_terms")).alias("n_terms")))
            buried = held.of("gone", forward.rows)
            again = written((buried if buried is not None else gone.limit(0)).select("chunk_id"))  # blocks still hold their postings
        fresh = forward.rows if again is None else forward.rows.join(again, "chunk_id", "left_anti")
        blocks_made = store.stage("blocks_of_terms", keyword.term_blocks(fresh))
        added = keyword.count_blocks(blocks_made.rows) if again is None else keyword.count_terms(forward.rows)
        if gone is not None:
            added = added.unionByName(lost_terms.select(added.columns))
        staged = [*together(lambda: store.stage("terms", added), lambda: store.stage("corpus", counted)), blocks_made]
        additions = [forward, *staged]
        removals = []
        if gone is not None:
            removals.append(store.stage_removal("forward", gone))
            if held.exists("gone"):
                removals.append(store.stage_removal("gone", again))
            additions.append(store.stage("gone", gone))
        if self.embed is not None:
            if gone is not None and held.exists("vectors"):
                removals.append(store.stage_removal("vectors", gone))
            additions.append(store.stage("vectors", models.embed_texts(texts.select("chunk_id", "stable_text"), self.embed).select("chunk_id", "embedding")))
        return removals, additions

    def index_chunks(self, rows: DataFrame, since: Snapshot | None = None) -> None:
        """Makes the stored index anew from ``chunk_id, stable_text``, in one commit; what it held before goes.

        Where ``rows`` say to what document, path and collection a chunk belongs, the places are made anew too.
        """
        place = ["chunk_id", "doc_id", "source_path", "collection"]
        replaced = [*INDEX, "places"] if set(place) <= set(rows.columns) else INDEX
        _, made = self._index_changes(Snapshot(self.store, -1, {}), rows, None)
        if "places" in replaced:
            made.append(self.store.stage("places", rows.select(*place, F.lit(True).alias("live"))))
        self.store.commit(made, replaced, since)

    def mend(self) -> list[str]:
        """Names of index tables with lost or broken files. If there are any, the index is made anew from the stored chunks.

        An ingest that commits meanwhile is a ``Conflict``, and nothing is changed.
        """
        held = self.store.snapshot()
        names = [*INDEX, "places"]
        broken = [n for n, sound in zip(names, together(*[partial(held.sound, n) for n in names]), strict=True) if not sound]
        if broken:
            self.index_chunks(held.read("chunks"), held)
        return broken

    def index(self, held: Snapshot | None = None) -> keyword.KeywordIndex | None:
        """The stored keyword index; None before the first ingest."""
        held = held or self.store.snapshot()
        if not held.exists("forward"):
            return None
        terms = keyword.merge_terms(held.read("terms"))
        summed = held.read("corpus").agg(F.sum("chunks").alias("chunks"), F.sum("n_terms").alias("n_terms"))
        return keyword.KeywordIndex(held.read("forward"), terms, keyword.corpus_row(summed, terms), held.read("blocks_of_terms"), held.read("gone"))

    def search(self, queries: DataFrame, collection: str | None = None, embeddings: DataFrame | None = None, query_embeddings: DataFrame | None = None, reranker: str = "noop") -> DataFrame:
        """Ranked candidates of ``query_id, query``: search in the stored keyword index, fused with vector search.

        Vectors are those given, or else the stored ones and the queries' own where the engine has a model. A scope is made of
        (chunk, collection) pairs, so a text of several collections is found in each; a collection without any chunk does not
        narrow the search. Texts are fetched for the fused candidates only. An empty store has no candidates.
        """
        held = self.store.snapshot()
        index = self.index(held)
        if index is None:
            kind = queries.schema["query_id"].dataType.simpleString()
            return self.spark.createDataFrame([], f"query_id {kind}, {CANDIDATE}")
        if embeddings is None and self.embed is not None and held.exists("vectors"):
            embeddings = held.read("vectors")
            query_embeddings = models.embed_texts(queries, self.embed, "query").select("query_id", "embedding")
        places = held.read("places").where("live")
        scope = None
        if collection is not None:
            inside = places.where(F.col("collection") == collection)
            if not inside.isEmpty():
                places, scope = inside, inside.select("chunk_id").distinct()
        lists = {"bm25": keyword.search(index, queries, 2 * self.top_k, scope)}
        if embeddings is not None and query_embeddings is not None:
            inside = embeddings if scope is None else embeddings.join(scope, "chunk_id", "left_semi")
            near = vectors.search(vectors.checked(inside), query_embeddings, 2 * self.top_k)
            lists["vector"] = near.withColumn("vector_score", -F.col("l2sq"))
        fused = written(fusion.rrf(lists, top=2 * self.top_k))
        found = places.join(fused.select("chunk_id").distinct(), "chunk_id", "left_semi")
        one = written(found.groupBy("chunk_id").agg(F.min(F.struct("source_path", "doc_id", "collection")).alias("p")).select("chunk_id", "p.*"))
        texts = held.of("chunks", one).drop("source_path", "collection").join(one, ["chunk_id", "doc_id"])
        rows = fused.join(texts, "chunk_id").join(queries, "query_id")
        return fusion.build_reranker(reranker)(fusion.language_filter(rows), self.top_k)

    def answer(self, queries: DataFrame, candidates: DataFrame, save: bool = False) -> dict[str, DataFrame]:
        """Packed context, prompts, answers with whether they abstain, their spans, the citations they use, and a timed trace.

        Answers come from the engine's model, or are extracted where it has none or it fails. ``trace`` has a row for each of
        the steps pack, generate and cite with its seconds and counts; every step is computed once. With ``save`` the trace
        and the answers are added to the store.
        """
        run_id, began, events = uuid.uuid4().hex, time.time(), []

        def step(name: str, rows: DataFrame) -> DataFrame:
            nonlocal began
            done, n = counted(rows)
            events.append((run_id, name, round(time.time() - began, 6), n))
            began = time.time()
            return done

        label = F.element_at(F.split("source_path", "/"), -1)
        packed = step("pack", context.pack(candidates.withColumn("source_label", label), self.context_top_k, self.context_budget))
        asked = context.prompts(queries, packed)
        extracted = context.extractive_answers(packed)
        if self.complete is None:
            answers = extracted
        else:
            made = models.complete(asked, self.complete).select("query_id", F.col("answer").alias("made"))
            answers = made.join(extracted, "query_id", "left").select("query_id", F.coalesce("made", "answer").alias("answer"))
        answers = step("generate", answers.withColumn("abstained", context.abstained(F.col("answer"))))
        refs = packed.select("query_id", "ref_number", "chunk_id", "source_label")
        # An abstaining answer cites nothing.
        cited = step("cite", context.cited_only(refs, answers.where("NOT coalesce(abstained, false)")))
        log = self.spark.createDataFrame(events, "run_id string, stage string, seconds double, n_rows long")
        if save:
            of_run = answers.select(F.lit(run_id).alias("run_id"), F.col("query_id").cast("string"), "answer", "abstained")
            self.store.commit([self.store.stage("runs", log), self.store.stage("answers", of_run)])
        return {"packed": packed, "prompts": asked, "answers": answers, "spans": context.spans(answers), "citations": cited, "trace": log}

    def evaluate(self, runs: DataFrame, qrels: DataFrame, k: int = 10) -> tuple[DataFrame, DataFrame]:
        """Metrics of every query, and their means."""
        rows = metrics.per_query(runs, qrels, k)
        return rows, metrics.macro(rows)

    def run_eval(self, cases: DataFrame, qrels: DataFrame, k: int = 10, collection: str | None = None) -> tuple[DataFrame, DataFrame]:
        """Searches and answers the cases (``query_id, query, expected_behavior``) and measures all of it itself.

        Returns a row per case (metrics, ``actual_behavior``, ``behaved``) and the one-row report: means over answerable
        cases, attribution of candidates by list, tokens saved by packing, and shares of behaviour as expected.
        """
        queries = cases.select("query_id", "query")
        found = written(self.search(queries, collection))
        made = self.answer(queries, found)
        label = fusion.source_label(F.col("bm25_score"), F.col("vector_score"), F.col("retrieval_source"))
        actual = F.when(F.coalesce("abstained", F.lit(True)), "abstain").otherwise("answer")
        behaviour = cases.select("query_id", "expected_behavior").join(made["answers"].select("query_id", "abstained"), "query_id", "left")
        behaviour = behaviour.select("query_id", "expected_behavior", actual.alias("actual_behavior"))
        behaved = F.col("actual_behavior") == F.coalesce("expected_behavior", F.lit("answer"))
        scored = metrics.per_query(found.select("query_id", "chunk_id", "rank"), qrels, k)
        rows = written(behaviour.withColumn("behaved", behaved).join(scored, "query_id", "left").na.fill(0, ["n_relevant", "hits", "recall", "mrr", "ndcg"]))
        report = metrics.report(
            rows,
            cases,
            attribution=metrics.source_attribution(found.withColumn("source_label", label)),
            efficiency=metrics.token_saving(made["packed"], found.withColumn("token_count", context.packing_tokens())),
            behaviour=rows.agg(F.count_if("behaved").alias("n_behaved"), F.round(F.avg(F.col("behaved").cast("int")), 6).alias("share_behaved")),
            seconds=made["trace"].agg(F.round(F.sum("seconds"), 6).alias("answering")),
        )
        return rows, report

    def run_benchmark(self, parts: dict[str, DataFrame], top_k: int = 100, k: int = 10, rebuild: bool = False) -> tuple[DataFrame, DataFrame]:
        """Retrieval over a judged corpus: ``chunks`` (chunk_id, stable_text), ``queries`` and ``qrels``, as :func:`files.beir` loads them.

        A row of the corpus is a chunk. It is indexed in the engine's store, which should be its own; a stored index is used again
        unless ``rebuild``. Only queries with judgements are run, fused with vector search where the engine has a model. Returns a
        row per query and the one-row report: means at ``k`` of the best ``top_k``, attribution, seconds of indexing and search.
        """
        _within("top_k", top_k, 1, 1000)
        began = time.time()
        if rebuild or not self.store.exists("forward"):
            self.index_chunks(parts["chunks"].select("chunk_id", "stable_text"))
        held = self.store.snapshot()
        indexed = time.time()
        judged = parts["qrels"].select("query_id").distinct()
        asked = written(parts["queries"].select("query_id", "query").join(judged, "query_id", "left_semi"))
        lists = {"bm25": keyword.search(self.index(held), asked, top_k)}
        if self.embed is not None and held.exists("vectors"):
            own = models.embed_texts(asked, self.embed, "query").select("query_id", "embedding")
            lists["vector"] = vectors.search(vectors.checked(held.read("vectors")), own, top_k).withColumn("vector_score", -F.col("l2sq"))
        found = written(fusion.rrf(lists, top=top_k))
        seconds = self.spark.createDataFrame([(round(indexed - began, 3), round(time.time() - indexed, 3))], "indexing double, searching double")
        qrels = parts["qrels"].join(asked.select("query_id"), "query_id", "left_semi")
        rows = written(metrics.per_query(found, qrels, k))
        label = fusion.source_label(F.col("bm25_score"), F.col("vector_score"), F.col("retrieval_source"))
        cases = asked.select("query_id", F.lit("answer").alias("expected_behavior"))
        return rows, metrics.report(rows, cases, attribution=metrics.source_attribution(found.withColumn("source_label", label)), seconds=seconds)

    def list_collections(self) -> DataFrame:
        """``collection, n_documents`` by name; an empty store has the default collection with none."""
        held = self.store.read("documents")
        default = self.spark.createDataFrame([("default", 0)], "collection string, n_documents long")
        if held is None or held.isEmpty():
            return default
        name = F.coalesce("collection", F.lit("default"))
        return held.groupBy(name.alias("collection")).agg(F.count("*").alias("n_documents")).orderBy("collection")

    def sync(self, connector: str, items: DataFrame, order: str = "cursor_after") -> DataFrame:
        """Ingests a connector's artifacts after its cursor, keyed by ``source_id``, and moves the cursor in the same commit.

        An artifact's text is ``content_text`` or else its decoded ``content_bytes``. Cursors
        compare as numbers where both are numbers, else as text. An artifact whose ``mime_type`` says ``error/...``
        will never have content: it is kept among the dead letters, and the cursor passes it. The cursor stops before the
        first other artifact without content, which the next run meets again; what lies after it is
        ingested all the same, and unchanged documents are skipped then.
        """
        raw = F.col("content_bytes") if "content_bytes" in items.columns else F.lit(None).cast("binary")
        kind = F.col("mime_type") if "mime_type" in items.columns else F.lit(None).cast("string")
        place = threads.ordered(F.col(order))
        fresh = items.select("source_id", order, files.artifact_text(F.nullif(F.trim("content_text"), F.lit("")), raw).alias("text"), kind.alias("kind"), place.alias("place"))
        cursor = self.store.cursor(connector)
        if cursor is not None:
            fresh = fresh.where(F.col("place") > threads.ordered(F.lit(cursor)))
        fresh = written(fresh)
        empty = F.coalesce(F.trim("text"), F.lit("")) == ""
        dead = empty & F.coalesce(F.col("kind").startswith("error/"), F.lit(False))
        stop = fresh.where(empty & ~dead).agg(F.min("place").alias("stop"))
        safe = fresh.where(~empty | dead).crossJoin(F.broadcast(stop)).where("stop IS NULL OR place < stop")  # one row
        last = safe.agg(F.max_by(order, "place").alias("cursor")).where("cursor IS NOT NULL")
        state = self.store.stage("connector_state", last.select(F.lit(connector).alias("connector_name"), F.col("cursor").cast("string").alias("cursor")))
        letters = fresh.where(dead).select(F.lit(connector).alias("connector_name"), F.col("source_id").cast("string"), F.col(order).cast("string").alias("cursor_after"), F.col("kind").alias("reason"))
        more = [state] if letters.isEmpty() else [state, self.store.stage("dead_letters", letters)]
        return self.ingest(fresh.where(~empty).select(F.col("source_id").alias("source_path"), "text"), tuple(more))

    def land(self, connector: str, artifacts: DataFrame, failed: DataFrame) -> DataFrame:
        """Ingests artifacts keyed by ``source_id`` without a cursor of its own, with ``failed`` (source_id, cursor_after, reason) and artifacts
        that say ``error/...`` as dead letters, in one commit."""
        raw = F.col("content_bytes") if "content_bytes" in artifacts.columns else F.lit(None).cast("binary")
        rows = artifacts.select("source_id", files.artifact_text(F.nullif(F.trim("content_text"), F.lit("")), raw).alias("text"), "cursor_after", "mime_type")
        empty = F.coalesce(F.trim("text"), F.lit("")) == ""
        broken = rows.where(empty).select("source_id", "cursor_after", F.coalesce("mime_type", F.lit("empty")).alias("reason"))
        letters = failed.unionByName(broken).select(F.lit(connector).alias("connector_name"), "source_id", "cursor_after", "reason")
        more = () if letters.isEmpty() else (self.store.stage("dead_letters", letters),)
        return self.ingest(rows.where(~empty).select(F.col("source_id").alias("source_path"), "text"), more)

    def saved_runs(self) -> DataFrame | None:
        """``run_id, stage, n_events, latency_ms`` of saved traces, in the order of the stages."""
        held = self.store.read("runs")
        return None if held is None else trace.by_stage(held.select("run_id", "stage", (F.col("seconds") * 1000).alias("latency_ms")))


#: Columns of a candidate beside its query.
CANDIDATE = (
    "chunk_id string, rrf_score double, rank int, bm25_score double, vector_score double, retrieval_source string, doc_id string, source_path string, "
    "collection string, stable_text string, display_text string, token_count int, query string, rerank_score double, final_score double"
)
