import pytest
from pyspark.sql import functions as F

from lodestone.operators import keyword, models, trace, vectors
from lodestone.operators.store import Store
from lodestone.plans.engine import Engine
from lodestone.sources import connectors, files, threads, web
from lodestone.streaming import incremental


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, Store(spark, f"file://{tmp_path}/store"), token_budget=64)


def documents(spark, rows):
    return spark.createDataFrame(rows, incremental.DOCUMENTS)


def test_ingest_search_and_reingest(spark, engine):
    first = [("a.txt", "Spark joins large tables.\nIt also sorts them well.", "db"), ("b.txt", "Cats sleep all day.", None)]
    assert engine.ingest(documents(spark, first)).count() == 2
    assert engine.ingest(documents(spark, first)).count() == 0
    changed = engine.ingest(documents(spark, [("a.txt", "Spark joins large tables.\nIt streams as well.", "db")])).first()
    assert (changed["blocks_unchanged"], changed["blocks_added"], changed["blocks_removed"]) == (1, 1, 1)
    assert engine.store.read("documents").count() == 2
    asked = spark.createDataFrame([(1, "how does Spark join tables")], "query_id int, query string")
    found = engine.search(asked)
    assert found.orderBy("rank").first()["source_path"] == "a.txt"
    parts = engine.answer(asked, found)
    assert "[1]" in parts["answers"].first()["answer"] and "=== Question ===" in parts["prompts"].first()["user"]
    assert {r["collection"]: r["n_documents"] for r in engine.list_collections().collect()} == {"db": 1, "default": 1}
    assert engine.search(asked, collection="default").count() == 0
    assert engine.search(asked, collection="of no document").first()["source_path"] == "a.txt"
    with pytest.raises(ValueError):
        Engine(spark, engine.store, token_budget=1)


def test_stream(spark, engine, tmp_path):
    documents(spark, [("s.txt", "Streams of text.", None)]).write.parquet(f"{tmp_path}/in")
    stream = incremental.document_stream(spark, f"file://{tmp_path}/in")
    incremental.ingest_stream(engine, stream, f"file://{tmp_path}/ck").awaitTermination(60)
    assert engine.store.read("documents").first()["source_path"] == "s.txt"


def test_sync_moves_cursor(spark, engine):
    items = spark.createDataFrame([("x", "text one", "1"), ("y", "", "2")], "source_id string, content_text string, cursor_after string")
    assert engine.sync("chat", items).count() == 1
    assert engine.store.cursor("chat") == "1"


def test_mail(spark):
    raw = b"Message-ID: <m1@x>\nSubject: Hi\nFrom: a@b\nContent-Type: text/plain\n\nBody here"
    row = connectors.mail_artifacts(spark.createDataFrame([("7", raw)], "uid string, raw binary")).first()
    assert row["source_id"] == "email:<m1@x>" and row["content_text"].endswith("Body here") and row["cursor_after"] == "7"


def test_chat_and_notes(spark):
    rows = [("c", "1", None, "u", "root"), ("c", "3", "1", "v", "late"), ("c", "2", "1", None, "early")]
    row = connectors.chat_artifacts(spark.createDataFrame(rows, "channel string, ts string, thread_ts string, user string, text string")).first()
    assert row["content_text"].split("\n") == ["[1] <u>: root", "[2] <unknown>: early", "[3] <v>: late"] and row["cursor_after"] == "3"
    blocks = [("heading_2", "T", None), ("to_do", "do", True), ("image", "x", None), ("paragraph", "p", None)]
    df = spark.createDataFrame([(blocks,)], "b array<struct<type:string,text:string,checked:boolean>>")
    assert df.select(connectors.note_text(F.col("b")).alias("t")).first()["t"] == "## T\n[x] do\np"


def test_listing_source(spark):
    connectors.register_listing(spark, "numbers_listing", "n int", lambda page: iter([(10 * page,), (10 * page + 1,)]))
    assert sorted(r["n"] for r in spark.read.format("numbers_listing").option("pages", 2).load().collect()) == [0, 1, 10, 11]


@pytest.mark.parametrize(
    ("url", "raw", "name", "extension"),
    [
        ("https://github.com/u/r/blob/main/README.md", "https://raw.githubusercontent.com/u/r/main/README.md", "README.md", ".md"),
        ("https://site.org/a/b/", "https://site.org/a/b/", "b.html", ".html"),
        ("https://site.org", "https://site.org", "site.org", ".html"),
    ],
)
def test_urls(spark, url, raw, name, extension):
    u = F.col("u")
    row = spark.createDataFrame([(url,)], "u string").select(web.raw_url(u).alias("r"), web.canonical_name(u).alias("n"), web.extension(u).alias("e")).first()
    assert tuple(row) == (raw, name, extension)


def test_files_and_settings(spark, tmp_path):
    (tmp_path / "a.TXT").write_bytes(b"ok \xff")
    row = files.raw_artifacts(spark, f"file://{tmp_path}/a.TXT").first()
    assert row["extension"] == ".txt" and row["text"] == "ok �" and row["file_size_bytes"] == 4
    assert files.merge_settings({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}


def test_rows_of_documents_come_in_order(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    wanted = spark.createDataFrame([("a",), ("a",), ("none",), (None,)], "doc_id string")
    assert store.of("blocks", wanted) is None
    store.save("blocks", spark.createDataFrame([("a", 2, "z"), ("b", 0, "y"), ("a", 10, "x"), ("a", 1, "w")], "doc_id string, sequence int, text string"))
    assert [(r["doc_id"], r["sequence"], r["text"]) for r in store.of("blocks", wanted).collect()] == [("a", 1, "w"), ("a", 2, "z"), ("a", 10, "x")]


def test_scan_gives_errors_as_rows(spark, tmp_path):
    (tmp_path / "A.TXT").write_text("whole text")
    paths = [f"file://{tmp_path}/A.TXT", f"file://{tmp_path}/none.txt", f"file://{tmp_path}"]
    rows = {r["error"]: r for r in files.scan(spark, paths).collect()}
    assert set(rows) == {None, "missing", "folder"}
    assert (rows[None]["text"], rows[None]["extension"]) == ("whole text", ".txt")
    assert rows["missing"]["source_path"] == paths[1] and rows["missing"]["content"] is None
    assert [r["error"] for r in files.scan(spark, paths[1:2]).collect()] == ["missing"]
    assert files.scan(spark, []).count() == 0


def test_threads_and_trace(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "bot", "yo")], "conv_id int, turn int, role string, text string")
    assert threads.flatten(rows, "conv_id", "turn", "role", "text").first()["text"] == "[0] <user>: hi\n[1] <bot>: yo"
    runs = spark.createDataFrame([("query", {"q": "x"}, 1), ("ingest", {"p": "y"}, 2)], "run_type string, metadata map<string,string>, created_at int")
    trace.save_runs(runs, f"file://{tmp_path}/runs")
    assert trace.list_runs(spark, f"file://{tmp_path}/runs", "query").count() == 1


def test_numeric_cursors_and_byte_artifacts(spark, engine):
    """UID 10 comes after 9; artifacts of bytes alone are ingested; the cursor stops before an artifact without content."""
    schema = "source_id string, content_text string, content_bytes binary, cursor_after string"
    assert engine.sync("mail", spark.createDataFrame([("a", "text of nine", None, "9")], schema)).count() == 1
    more = [("b", "text of ten", None, "10"), ("c", None, b"bytes of eleven", "11"), ("d", " ", None, "12"), ("e", "text of thirteen", None, "13")]
    assert engine.sync("mail", spark.createDataFrame(more, schema)).count() == 3
    assert engine.store.cursor("mail") == "11" and engine.store.read("documents").count() == 4
    assert engine.sync("mail", spark.createDataFrame([("d", "now there", None, "12"), more[3]], schema)).count() == 1
    assert engine.store.cursor("mail") == "13"


def test_a_lost_write_leaves_the_version_before(spark, tmp_path):
    """What a lost driver leaves, a segment without a manifest and half a draft of one, is no one's; old versions go."""
    store = Store(spark, f"file://{tmp_path}/store", keep=2, buckets=2, segments=2)
    rows = lambda *ids: spark.createDataFrame([(i,) for i in ids], "doc_id string")
    store.save("documents", rows("a", "b"))
    store.stage("documents", rows("lost"))
    (tmp_path / "store/_manifests/000000000001.json.0.draft").write_text("{")
    assert store.read("documents").count() == 2
    store.save("documents", rows("c"))
    assert {r["doc_id"] for r in store.read("documents").collect()} == {"a", "b", "c"}
    for i in range(8):
        store.save("documents", rows(f"d{i}"))
    assert store.read("documents").count() == 11 and len(list((tmp_path / "store/documents").glob("[0-9a-f]*"))) <= 8
    assert len(list((tmp_path / "store/_manifests").glob("*.json"))) == 2


def test_odd_vectors_are_left_out(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [1.0, None]), (4, [1.0, 0.0, 0.0]), (5, [0.9, 0.1])]
    df = spark.createDataFrame(rows, "chunk_id int, embedding array<float>")
    found = vectors.search(df, df.withColumnRenamed("chunk_id", "query_id"), 3).collect()
    assert {(r["query_id"], r["chunk_id"]) for r in found} == {(1, 1), (1, 5), (5, 5), (5, 1), (4, 4)}


def test_broken_mail_is_a_row(spark):
    df = spark.createDataFrame([("1", None)], "uid string, raw binary")
    row = connectors.mail_artifacts(df).first()
    assert row["content_text"] is None and row["mime_type"].startswith("error/") and row["cursor_after"] == "1"


def test_stored_index_follows_the_chunks(spark, tmp_path):
    """After changes the stored index equals one built anew, and only new chunks are embedded."""
    engine = Engine(spark, Store(spark, f"file://{tmp_path}/store"), token_budget=64, embed=models.hash_vectors)
    engine.ingest(documents(spark, [("a.txt", "Spark joins large tables.", "db"), ("b.txt", "Cats sleep all day.", None)]))
    before = {r["chunk_id"] for r in engine.store.read("vectors").collect()}
    engine.ingest(documents(spark, [("a.txt", "Spark sorts large tables and joins.", "db"), ("c.txt", "Dogs bark at cats.", None)]))
    held = engine.store.read("chunks")
    fresh = keyword.build(held)
    for name in ("postings", "lengths", "statistics"):
        columns = getattr(fresh, name).columns
        rows = lambda t: sorted(tuple(map(str, r)) for r in t.select(columns).collect())  # noqa: B023, E731
        assert rows(getattr(engine.index(), name)) == rows(getattr(fresh, name)), name
    ids = {r["chunk_id"] for r in held.collect()}
    assert {r["chunk_id"] for r in engine.store.read("vectors").collect()} == ids and len(before & ids) == 1
    found = engine.search(spark.createDataFrame([(1, "cats")], "query_id int, query string"))
    assert {r["source_path"] for r in found.collect()} == {"b.txt", "c.txt", "a.txt"}
    path = f"file://{tmp_path}/index"
    fresh.save(path)
    assert keyword.KeywordIndex.load(spark, path).postings.count() == fresh.postings.count()


def test_a_text_of_two_collections_is_found_in_each(spark, engine):
    shared = "Shared words of two collections."
    engine.ingest(documents(spark, [("a.txt", shared, "db"), ("b.txt", shared, "web"), ("c.txt", "Only of the web.", "web")]))
    asked = spark.createDataFrame([(1, "shared words")], "query_id int, query string")
    for name, path in (("db", "a.txt"), ("web", "b.txt")):
        rows = engine.search(asked, collection=name).collect()
        assert [(r["source_path"], r["collection"]) for r in rows] == [(path, name)]
    engine.ingest(documents(spark, [("a.txt", "Quite another text.", "db")]))
    assert [r["source_path"] for r in engine.search(asked).collect()] == ["b.txt"]  # the chunk stays, as b.txt has it
    engine.ingest(documents(spark, [("b.txt", "Something else.", "web")]))
    assert engine.search(asked).count() == 0
    engine.ingest(documents(spark, [("d.txt", shared, "db")]))  # a chunk that was removed comes back
    rows = engine.search(asked).collect()
    assert [(r["source_path"], r["rank"]) for r in rows] == [("d.txt", 1)]
    fresh = keyword.search(keyword.build(engine.store.read("chunks").dropDuplicates(["chunk_id"])), asked, 5).first()
    assert rows[0]["bm25_score"] == pytest.approx(fresh["bm25_score"])


def test_an_empty_store_answers(spark, engine):
    asked = spark.createDataFrame([(1, "anything")], "query_id int, query string")
    found = engine.search(asked, collection="x")
    assert found.count() == 0 and [tuple(r) for r in engine.list_collections().collect()] == [("default", 0)]
    made = engine.answer(asked, found)
    assert made["packed"].count() == 0 and made["citations"].count() == 0 and made["trace"].count() == 3


def test_artifacts_that_never_have_content_are_dead_letters(spark, engine):
    schema = "source_id string, content_text string, content_bytes binary, mime_type string, cursor_after string"
    items = [("m9", "mail nine", None, "text/plain", "9"), ("m9/pdf", None, None, "error/too-large", "9"), ("m10", "mail ten", None, "text/plain", "10"), ("m11", "mail eleven", None, "text/plain", "11")]
    assert engine.sync("mail", spark.createDataFrame(items, schema)).count() == 3
    assert engine.store.cursor("mail") == "11"
    assert [(r["source_id"], r["reason"]) for r in engine.store.read("dead_letters").collect()] == [("m9/pdf", "error/too-large")]
    late = [("m12", None, None, "error/UnicodeError", "12"), ("m13", " ", None, "text/plain", "13"), ("m14", "mail fourteen", None, "text/plain", "14")]
    assert engine.sync("mail", spark.createDataFrame(late, schema)).count() == 1
    assert engine.store.cursor("mail") == "12" and engine.store.read("dead_letters").count() == 2  # 13 may still get content


def test_answers_of_a_model_with_trace_and_report(spark, tmp_path):
    def model(prompts):
        if any("cats" in p for p in prompts):
            raise RuntimeError("down")
        return ["It joins [1]." if "join" in p else "I cannot answer." for p in prompts]

    engine = Engine(spark, Store(spark, f"file://{tmp_path}/store"), token_budget=64, complete=model)
    engine.ingest(documents(spark, [("dir/a.txt", "Spark joins large tables.", None), ("b.txt", "Cats sleep all day.", None)]))
    cases = spark.createDataFrame([(1, "spark join tables", "answer"), (2, "sleep of the day", "abstain"), (3, "zebra", "abstain")], "query_id int, query string, expected_behavior string")
    found = engine.search(cases.select("query_id", "query"))
    made = engine.answer(cases.select("query_id", "query"), found, save=True)
    answers = {r["query_id"]: (r["answer"], r["abstained"]) for r in made["answers"].collect()}
    assert answers[1] == ("It joins [1].", False) and answers[2][1] and answers[3][1]
    assert [(r["query_id"], r["ref_number"], r["source_label"]) for r in made["citations"].collect()] == [(1, 1, "a.txt")]
    spans = made["spans"].where("query_id = 1").orderBy("span_no").collect()
    assert [r["span_type"] for r in spans] == ["answer", "citation_marker", "answer"]
    saved = engine.saved_runs().collect()
    assert [r["stage"] for r in saved] == ["pack", "generate", "cite"] and all(r["latency_ms"] >= 0 for r in saved)
    assert engine.store.read("answers").count() == 3
    qrels = spark.createDataFrame([(1, r["chunk_id"]) for r in found.where("query_id = 1").collect()], "query_id int, chunk_id string")
    rows, report = engine.run_eval(cases, qrels)
    assert {r["query_id"]: (r["actual_behavior"], r["behaved"]) for r in rows.collect()} == {1: ("answer", True), 2: ("abstain", True), 3: ("abstain", True)}
    r = report.first()
    assert (r["n_queries"], r["recall"], r["behaviour"]["share_behaved"], r["attribution"]["n_bm25_only"]) == (1, 1.0, 1.0, 2)
    assert r["efficiency"]["n_queries"] == 2 and r["seconds"]["answering"] > 0
