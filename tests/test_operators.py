import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import blocks, chunks, clean, context, fusion, identity, keyword, metrics, models, parse, vectors


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def one(spark, column, value, kind="string"):
    return frame(spark, [(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


def test_text_functions(spark):
    assert one(spark, T.canonical, " a \t b c ") == "a b c"
    assert one(spark, T.sentences, "One. Two!  Three? four") == ["One.", "Two!", "Three?", "four"]
    assert one(spark, T.token_estimate, "abc") == 1
    assert one(spark, T.terms, "Ab-cé 12") == ["ab", "cé", "12"]
    assert one(spark, T.terms, "查 询") == ["查", "询"]


def test_sub_split_never_cuts_a_sentence(spark):
    long = "a" * 40 + ". " + "b" * 400 + ". c."
    rows = blocks.split_blocks(frame(spark, [(1, 0, long)], "doc_id long, pos int, text string"), 20).orderBy("sequence").collect()
    assert [r["text"][0] for r in rows] == ["a", "b", "c"]
    assert [r["sequence"] for r in rows] == [0, 1, 2]


def test_cleaning_steps(spark):
    rows = [(1, 0, "Home | About | Contact"), (1, 1, " text "), (1, 2, "text"), (1, 3, "  "), (1, 4, "ﬁne “é”")]
    df = frame(spark, rows, "doc_id long, pos int, text string")
    out = clean.clean(df, ["unicode_fix", "empty_filter", "html_nav_footer_remove", "dedupe_paragraphs"]).orderBy("pos")
    assert [r["text"] for r in out.collect()] == [" text ", 'fine "é"']
    with pytest.raises(ValueError):
        clean.clean(df, ["nothing"])


def test_ocr_lines(spark):
    assert one(spark, clean.merged_lines, "a\nb.\n\nc\nd") == "a b.\nc d"
    assert one(spark, clean.merged_lines, "alone") == "alone"


def test_repeated_headers(spark):
    rows = [(1, p, "head" if i == 0 else f"body {p}", p) for p in range(4) for i in range(2)]
    out = clean.drop_repeated_headers(frame(spark, rows, "doc_id long, pos int, text string, page int"))
    assert {r["text"] for r in out.collect()} == {f"body {p}" for p in range(4)}


@pytest.mark.parametrize(
    ("text", "kind", "level"),
    [("2.1 Scope", "section", 1), ("## Two", "heading", 2), ("- item", "list", 1), ("ABOUT US", "heading", 2), ("plain words", "none", 0)],
)
def test_anchors(spark, text, kind, level):
    row = chunks.annotate(frame(spark, [(text,)], "text string")).first()
    assert (row["anchor_type"], row["anchor_level"]) == (kind, level)


def test_packing_flushes_at_anchors_and_budget(spark):
    rows = [(1, 0, "# A", "h0", 1), (1, 1, "x", "h1", 10), (1, 2, "# B", "h2", 1), (1, 3, "y", "h3", 60), (1, 4, "z", "h4", 60)]
    df = chunks.annotate(frame(spark, rows, "doc_id long, sequence int, text string, block_hash string, n_tokens int"))
    built = chunks.build_chunks(chunks.assign_chunks(df, 64)).orderBy("chunk_no").collect()
    assert [r["stable_text"] for r in built] == ["# A\n\n# A: x", "# B\n\n# B: y", "z"]
    assert built[0]["display_text"].startswith("[HEADING] # A")


def test_pronouns(spark):
    score, hits, words = chunks.pronoun_risk(F.col("x"))
    row = frame(spark, [("It is what they gave us today",)], "x string").select(score.alias("s"), hits.alias("h"), words.alias("w")).first()
    assert (round(row["s"], 4), row["h"], row["w"]) == (0.4286, 3, 7)


def test_diff_guardrail_resync(spark):
    old = frame(spark, [(1, i, c) for i, c in enumerate("abcde")], "doc_id long, pos int, block_hash string")
    new = frame(spark, [(1, i, c) for i, c in enumerate("abxde")], "doc_id long, pos int, block_hash string")
    diff = identity.diff_blocks(old, new, ["doc_id"])
    assert {(r["block_hash"], r["status"]) for r in diff.collect()} == {*((c, "unchanged") for c in "abde"), ("x", "added"), ("c", "removed")}
    assert identity.guardrail(diff, ["doc_id"]).first()["level"] == "none"
    sign = lambda d: d.withColumnRenamed("block_hash", "chunk_signature")
    actions = identity.resync(sign(old), sign(new), 1).orderBy("pos").collect()
    assert [r["action"] for r in actions] == ["reuse", "reembed", "reembed", "reembed", "reuse"]
    assert identity.resync_stats(identity.resync(sign(old), sign(new), 1, 0.5)).first()["savings_ratio"] == 0
    with pytest.raises(ValueError):
        identity.resync(sign(old), sign(new), -1)


def test_upsert_and_latest(spark):
    table = frame(spark, [(1, "a"), (2, "b")], "k int, v string")
    assert {tuple(r) for r in identity.upsert(table, frame(spark, [(2, "c"), (3, "d")], "k int, v string"), ["k"]).collect()} == {(1, "a"), (2, "c"), (3, "d")}
    docs = frame(spark, [(1, "p", 1), (2, "p", 2)], "doc_id long, source_path string, ingest_seq int")
    assert identity.latest_version(docs).first()["doc_id"] == 2


def test_keyword_search(spark):
    rows = [("c1", "Python is a language"), ("c2", "the cat sat"), ("c3", "a language of cats"), ("c4", "dogs"), ("c5", "birds fly")]
    index = keyword.build(frame(spark, rows, "chunk_id string, stable_text string"))
    asked = frame(spark, [(1, "Python programming language")], "query_id int, query string")
    assert [r["chunk_id"] for r in keyword.search(index, asked, 2).orderBy("rank").collect()] == ["c1", "c3"]
    gone = frame(spark, [("c1",)], "chunk_id string")
    assert [r["chunk_id"] for r in keyword.search(keyword.remove(index, gone), asked, 5).collect()] == ["c3"]


def test_keyword_search_fills_up(spark):
    rows = [("c1", "Python is a language"), ("c2", "the cat sat"), ("c3", "a language of cats"), ("c4", None), ("c5", "birds fly")]
    index = keyword.build(frame(spark, rows, "chunk_id string, stable_text string"))
    asked = frame(spark, [(1, "Python programming language"), (2, "nothing here"), (3, None)], "query_id int, query string")

    def ids(scope=None):
        found = keyword.search(index, asked, 3, scope, fill=True).orderBy("query_id", "rank").collect()
        assert all((r["bm25_score"] == 0) == (r["query_id"] > 1 or r["chunk_id"] not in ("c1", "c3")) for r in found)
        return [[r["chunk_id"] for r in found if r["query_id"] == q] for q in (1, 2, 3)]

    assert ids() == [["c1", "c3", "c2"], ["c1", "c2", "c3"], ["c1", "c2", "c3"]]
    assert ids(frame(spark, [("c3",), ("c5",)], "chunk_id string")) == [["c3", "c5"]] * 3
    assert ids(frame(spark, [(1, "c5"), (2, "c4"), (2, "c4")], "query_id int, chunk_id string")) == [["c5"], ["c4"], []]
    empty = keyword.build(frame(spark, [], "chunk_id string, stable_text string"))
    assert keyword.search(empty, asked, 3, fill=True).count() == 0


def test_vector_search_in_blocks(spark):
    rows = [(i, [float(i), 0.0]) for i in range(50)]
    v = frame(spark, rows, "chunk_id int, embedding array<float>")
    q = frame(spark, [(i, [i + 0.1, 0.0]) for i in range(0, 50, 10)], "query_id int, embedding array<float>")
    found = vectors.search(v, q, 2, block=3).where("rank = 1").orderBy("query_id").collect()
    assert [(r["query_id"], r["chunk_id"]) for r in found] == [(i, i) for i in range(0, 50, 10)]


def test_fusion(spark):
    a = frame(spark, [(1, "x", 1, 2.0), (1, "y", 2, 1.0)], "query_id int, chunk_id string, rank int, bm25_score double")
    b = frame(spark, [(1, "y", 1, -0.1), (1, "z", 2, -0.2)], "query_id int, chunk_id string, rank int, vector_score double")
    out = fusion.rrf({"bm25": a, "vector": b}).orderBy("rank").collect()
    assert [r["chunk_id"] for r in out] == ["y", "x", "z"]
    assert out[0]["retrieval_source"] == "hybrid" and out[0]["rrf_score"] == round(1 / 62 + 1 / 61, 9)
    assert fusion.rrf({"bm25": a}).where("chunk_id = 'x'").first()["retrieval_source"] == "bm25"
    merged = {r["chunk_id"]: r["retrieval_source"] for r in fusion.attribute(a, b).collect()}
    assert merged == {"x": "bm25", "y": "hybrid", "z": "vector"}
    with pytest.raises(ValueError):
        fusion.rrf({"bm25": a}, k=0)


def test_context(spark):
    rows = [(1, 1, "a", "same", 10), (1, 2, "b", "same ", 10), (1, 3, "c", "other", 20), (1, 4, "d", "late", 5)]
    df = frame(spark, rows, "query_id int, rank int, chunk_id string, stable_text string, token_count int")
    df = df.withColumns({"display_text": F.col("stable_text"), "source_label": F.lit("s")})
    assert [r["chunk_id"] for r in context.pack(df, 6, 25).collect()] == ["a"]
    assert {r["chunk_id"]: r["reason"] for r in context.drop_reasons(df, 6, 25).collect()} == {"b": "duplicate", "c": "budget", "d": "budget"}
    answers = frame(spark, [(1, "One [2]. Two."), (2, "I cannot answer this")], "query_id int, answer string")
    spans = context.spans(answers.where("query_id = 1")).orderBy("span_no").collect()
    assert [(r["span_type"], r["start"], r["end"]) for r in spans] == [("answer", 0, 4), ("citation_marker", 4, 7), ("answer", 7, 13)]
    assert [r["y"] for r in answers.select(context.abstained(F.col("answer")).alias("y")).collect()] == [False, True]


def test_metrics(spark):
    runs = frame(spark, [(1, "a", 1), (1, "b", 2), (2, "c", 1)], "query_id int, chunk_id string, rank int")
    qrels = frame(spark, [(1, "b"), (1, "z")], "query_id int, chunk_id string")
    rows = {r["query_id"]: r for r in metrics.per_query(runs, qrels, 10).collect()}
    assert (rows[1]["recall"], rows[1]["mrr"]) == (0.5, 0.5) and abs(rows[1]["ndcg"] - 0.386853) < 1e-6
    assert rows[2]["recall"] == 0
    assert {r["outcome"]: r["n"] for r in metrics.outcomes(metrics.per_query(runs, qrels)).collect()} == {"PASS": 1, "SKIP": 1}
    with pytest.raises(ValueError):
        metrics.per_query(runs, qrels, 0)


def test_sniff_and_route(spark):
    rows = [(b"%PDF-1.7", "a.bin"), (b"PK\x03\x04..", "a.docx"), (b"PK\x03\x04..", "a.zip"), (b"  <!DOCTYPE html>", "a.x"), (b"text", "a.md"), (b"?", "a")]
    out = frame(spark, rows, "content binary, name string").select(parse.sniff(F.col("content"), F.col("name")).alias("s")).select("s.*")
    assert [r["detected_type"] for r in out.collect()] == ["pdf", "docx", "unsupported", "html", "markdown", "unknown"]
    assert [r["unsupported"] for r in parse.route(out).collect()] == [False, False, True, False, False, True]


def test_markdown(spark):
    text = "# A\npara one\nmore\n\n## B\n```\ncode\n```\nlast"
    out = parse.markdown_blocks(frame(spark, [(1, text), (2, "")], "doc_id long, text string")).orderBy("pos").collect()
    assert [(r["block_type"], r["text"], r["section_path"]) for r in out] == [
        ("heading", "A", []),
        ("paragraph", "para one\nmore", ["A"]),
        ("heading", "B", ["A"]),
        ("code", "code", ["A", "B"]),
        ("paragraph", "last", ["A", "B"]),
    ]


def test_parse_files_falls_back(spark):
    rows = [("a.md", b"# T\nbody", "markdown", ["md_parser"]), ("b.pdf", b"%PDF", "pdf", ["pymupdf"])]
    out = parse.parse_files(frame(spark, rows, "path string, content binary, detected_type string, candidates array<string>")).orderBy("path", "pos").collect()
    assert [(r["path"], r["text"], r["parser"]) for r in out] == [("a.md", "T", "md_parser"), ("a.md", "body", "md_parser"), ("b.pdf", "[unsupported_format: pdf]", "none")]


def test_models(spark):
    df = frame(spark, [("a b",), ("",)], "stable_text string")
    out = models.embed_texts(df, lambda texts: [[float(len(t)), 1.0] for t in texts]).collect()
    assert [list(r["embedding"]) for r in out] == [[3.0, 1.0], [0.0, 1.0]]
    v = models.embed_texts(df, models.hash_vectors).collect()
    assert abs(sum(x * x for x in v[0]["embedding"]) - 1) < 1e-6 and sum(v[1]["embedding"]) == 0


def test_rows_of_documents_equal_their_blocks(spark):
    """Metrics and first lines within a row are those of the exploded blocks, and need no exchange."""
    rows = [(1, "a\n b \nb\n\na\na"), (2, None), (3, ""), (4, "one\ttab\u0007bell\nx"), (5, "z\n" * 3000 + "y\nz")]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    as_set = lambda df: {tuple(r) for r in df.collect()}
    assert as_set(blocks.document_metrics(docs)) == as_set(blocks.parse_metrics(blocks.line_blocks(docs)))
    kept = clean.dedupe_document_lines(docs)
    assert as_set(kept) == as_set(clean.dedupe_paragraphs(blocks.line_blocks(docs)).select("doc_id", "pos", "text"))
    for df in (blocks.document_metrics(docs), kept):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_model_hooks_fall_back(spark):
    """Batched completion, enrichment and pair scores; failing calls leave null or the values of the rules."""
    rows = spark.createDataFrame([(i, f"Text number {i}.") for i in range(10)], "chunk_id int, stable_text string").coalesce(1)

    def upper(prompts):
        if any("7" in p for p in prompts):
            raise ValueError
        return [p.upper() for p in prompts]

    got = {r["chunk_id"]: r["answer"] for r in models.complete(rows, upper, "stable_text", batch=5).collect()}
    assert got[0] == "TEXT NUMBER 0." and got[6] is None and len(got) == 10

    def titled(prompts):
        return ["not json" if "[0] Text number 8" in prompts[0] else '[{"title": "T", "summary": "S", "tags": ["a"]}]']

    made = {r["chunk_id"]: (r["title"], r["tags"]) for r in models.enrich_by_model(rows, titled).collect()}
    assert made[0] == ("T", ["a"]) and made[1] == ("", []) and made[8][0] == "Text number 8."
    asked = rows.selectExpr("1 AS query_id", "chunk_id", "chunk_id + 1 AS rank", "'q' AS query", "stable_text")
    best = fusion.rerank_pairs(asked, lambda pairs: [float(t[12]) for _, t in pairs], 2, batch=3).orderBy("rank").collect()
    assert [r["chunk_id"] for r in best] == [9, 8]


def test_overwrite_policy_and_report(spark, tmp_path):
    rows = spark.createDataFrame([(1, "Some text here.", "Own", ""), (2, "Other text.", None, "kept")], "chunk_id int, stable_text string, title string, summary string")
    got = {r["chunk_id"]: (r["title"], r["summary"]) for r in chunks.enrich(rows, overwrite=False).collect()}
    assert got == {1: ("Own", "Some text here."), 2: ("Other text.", "kept")}
    judged = spark.createDataFrame([(1, 1.0, 1.0, 1.0), (2, 0.0, 0.0, 0.0)], "query_id int, recall double, mrr double, ndcg double")
    cases = spark.createDataFrame([(1, "answer"), (2, "abstain")], "query_id int, expected_behavior string")
    row = metrics.report(judged, cases, latency=spark.range(1).selectExpr("31.5 AS mean_ms"))
    metrics.write_report(row, f"file://{tmp_path}/report")
    held = spark.read.json(f"file://{tmp_path}/report").first()
    assert held["n_queries"] == 1 and held["recall"] == 1.0 and held["latency"]["mean_ms"] == 31.5
