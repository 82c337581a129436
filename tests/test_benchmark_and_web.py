"""Judged corpora in a stored index, mending of an index, fetching of pages, counts taken by the writing job."""

import json
import pathlib
import shutil

import pytest
from pyspark.sql import functions as F

from lodestone.operators import metrics, models
from lodestone.operators.store import Conflict, Store
from lodestone.plans.engine import INDEX, Engine
from lodestone.scratch import counted
from lodestone.sources import files, web
from lodestone.streaming import incremental

CORPUS = [("d1", "Joins", "spark joins large tables"), ("d2", "", "cats sleep all day"), ("d3", "Sorting", "tables are sorted by spark"), ("d4", "", "")]


@pytest.fixture
def folder(tmp_path):
    lines = lambda rows: "\n".join(json.dumps(x) for x in rows)
    (tmp_path / "beir/qrels").mkdir(parents=True)
    (tmp_path / "beir/corpus.jsonl").write_text(lines({"_id": i, "title": t, "text": x} for i, t, x in CORPUS))
    (tmp_path / "beir/queries.jsonl").write_text(lines([{"_id": "q1", "text": "who joins tables"}, {"_id": "q2", "text": "sleepy cats"}, {"_id": "q3", "text": "spark"}]))
    (tmp_path / "beir/qrels/test.tsv").write_text("query-id\tcorpus-id\tscore\nq1\td3\t1\nq2\td2\t2\nq3\td1\t0\n")
    return f"file://{tmp_path}/beir"


def test_benchmark_of_a_folder(spark, folder, tmp_path):
    engine = Engine(spark, Store(spark, f"file://{tmp_path}/store", buckets=4))
    parts = files.beir(spark, folder)
    rows, report = engine.run_benchmark(parts)
    found = {r["query_id"]: r for r in rows.collect()}
    assert set(found) == {"q1", "q2"}  # q3 has no positive judgement and is not run
    assert (found["q1"]["mrr"], found["q2"]["mrr"], found["q1"]["recall"]) == (0.5, 1.0, 1.0)
    row = report.first()
    assert (row["n_queries"], row["mrr"], row["attribution"]["n_bm25_only"], row["attribution"]["total"]) == (2, 0.75, 3, 3)
    assert row["seconds"]["indexing"] > 0 and row["seconds"]["searching"] > 0
    metrics.write_report(report, f"file://{tmp_path}/report")
    assert spark.read.json(f"file://{tmp_path}/report").first()["ndcg"] == row["ndcg"]
    before = engine.store.snapshot().number
    assert engine.run_benchmark(parts, top_k=1)[1].first()["mrr"] == 0.5  # of q1 only the first, wrong one is left
    assert engine.store.snapshot().number == before  # the stored index is used again
    changed = parts | {"chunks": parts["chunks"].where("chunk_id <> 'd1'")}
    assert engine.run_benchmark(changed)[1].first()["mrr"] == 0.75
    assert engine.run_benchmark(changed, rebuild=True)[1].first()["mrr"] == 1.0
    with pytest.raises(ValueError):
        engine.run_benchmark(parts, top_k=0)


def test_benchmark_with_a_model(spark, folder, tmp_path):
    engine = Engine(spark, Store(spark, f"file://{tmp_path}/store", buckets=4), embed=models.hash_vectors)
    row = engine.run_benchmark(files.beir(spark, folder))[1].first()
    assert row["n_queries"] == 2 and row["attribution"]["n_both"] == 3 and row["attribution"]["n_vector_only"] == row["attribution"]["total"] - 3


def files_of(engine, name):
    entry = engine.store.snapshot().tables[name]["segments"][0]
    return sorted(pathlib.Path(f"{engine.store.path.removeprefix('file://')}/{name}/{entry['id']}").glob("*/*.parquet"))


def test_broken_index_is_made_anew(spark, tmp_path):
    engine = Engine(spark, Store(spark, f"file://{tmp_path}/store"), token_budget=64, embed=models.hash_vectors)
    assert engine.mend() == []
    docs = [(f"{w}.txt", f"{w} is a word. Spark holds {w}.", c) for w, c in (("alpha", "a"), ("beta", None), ("gamma", "a"))]
    engine.ingest(spark.createDataFrame(docs, incremental.DOCUMENTS))
    engine.ingest(spark.createDataFrame([("beta.txt", "delta comes instead.", None)], incremental.DOCUMENTS))
    asked = spark.createDataFrame([(1, "alpha spark"), (2, "delta"), (3, "beta")], "query_id int, query string")
    look = lambda: sorted((r["query_id"], r["rank"], r["source_path"], r["bm25_score"], r["collection"]) for r in engine.search(asked, "a").collect())
    whole = look()
    assert engine.mend() == [] and whole
    with files_of(engine, "terms")[0].open("r+b") as f:
        f.truncate(10)
    files_of(engine, "forward")[0].unlink()  # its folder stays: told by the count of rows
    shutil.rmtree(files_of(engine, "places")[0].parent)
    assert sorted(engine.mend()) == ["forward", "places", "terms"]
    assert look() == whole and engine.mend() == []
    again = engine.ingest(spark.createDataFrame([("new.txt", "alpha again and again.", "a")], incremental.DOCUMENTS))
    assert again.count() == 1 and "new.txt" in {x[2] for x in look()}


def test_mending_gives_way_to_a_commit(spark, tmp_path):
    engine = Engine(spark, Store(spark, f"file://{tmp_path}/store"), token_budget=64)
    engine.ingest(spark.createDataFrame([("a.txt", "some words here", None)], incremental.DOCUMENTS))
    held = engine.store.snapshot()
    engine.store.save("connector_state", spark.createDataFrame([("mail", "7")], "connector_name string, cursor string"))
    with pytest.raises(Conflict):
        engine.index_chunks(held.read("chunks"), held)
    assert engine.store.cursor("mail") == "7" and set(INDEX) & set(engine.store.snapshot().tables) == set(INDEX) & set(held.tables)


def test_replaced_tables_keep_their_buckets(spark, tmp_path):
    """A store opened with another number of buckets stages with the table's own, and says so in the manifest."""
    path = f"file://{tmp_path}/store"
    rows = spark.createDataFrame([(f"c{i}", f"word{i} spark") for i in range(40)], "chunk_id string, stable_text string")
    Engine(spark, Store(spark, path, buckets=4)).index_chunks(rows)
    store = Store(spark, path, buckets=16)
    Engine(spark, store).index_chunks(rows)
    held = store.snapshot()
    assert {t["n"] for t in held.tables.values()} == {4}
    assert held.lookup("forward", ["c7", "c21"]).count() == 2


@pytest.mark.parametrize("n", [0, 1, 1000])
def test_counted_rows(spark, n):
    out, seen = counted(spark.range(n).where("id >= 0").repartition(3))
    assert (seen, out.count()) == (n, n)


def test_fetch(spark, tmp_path):
    log = tmp_path / "calls"
    log.mkdir()

    def fetch(url):
        name = url.replace("/", "_")
        seen = len(list(log.glob(f"{name}.*")))
        (log / f"{name}.{seen}").touch()
        if "down" in url or ("once" in url and seen == 0):
            raise OSError("no answer")
        return b"" if "empty" in url else b"<html><nav>menu</nav><p>Text of \xff page</p></html>" if url.endswith("page") else b"# plain"

    asked = [" https://a.org/page ", "https://a.org/page", "https://a.org/once/x.txt", "https://a.org/down", "https://a.org/empty", "  ", "", None]
    asked += ["https://github.com/u/r/blob/main/README.md", "https://raw.githubusercontent.com/u/r/main/README.md"]
    pages = web.fetched(spark.createDataFrame([(u,) for u in asked], "url string"), fetch, tries=2, wait=0.0, partitions=3)
    made = {r["source_id"]: (r["file_name"], r["mime_type"], r["content_text"]) for r in web.artifacts(pages).collect()}
    assert made == {
        "https://a.org/page": ("page.html", "text/html", "Text of � page"),
        "https://a.org/once/x.txt": ("x.txt", "text/plain", "# plain"),
        "https://raw.githubusercontent.com/u/r/main/README.md": ("README.md", "text/markdown", "# plain"),
    }
    lost = {r["source_id"]: r["reason"] for r in web.failures(pages).collect()}
    assert lost == {"https://a.org/down": "OSError: no answer", "https://a.org/empty": "empty"}
    calls = sorted(p.name.rpartition("_")[2] for p in log.iterdir())
    assert calls == ["README.md.0", "down.0", "down.1", "empty.0", "page.0", "x.txt.0", "x.txt.1"]
    engine = Engine(spark, Store(spark, f"file://{tmp_path}/store"), token_budget=64)
    assert engine.land("web", web.artifacts(pages).drop("url"), web.failures(pages)).count() == 3
    assert {r["source_id"] for r in engine.store.read("dead_letters").collect()} == set(lost)
    none = web.fetched(spark.createDataFrame([], "url string"), fetch)
    assert none.count() == web.artifacts(none).count() == web.failures(none).count() == 0
    with pytest.raises(ValueError):
        web.fetched(pages, fetch, tries=0)


def test_unknown_names_stay_unknown(spark):
    from lodestone.operators import parse

    rows = [(b"x", None), (b"x", "a.PDF"), (b"x", "a.zzz"), (b"PK\x03\x04", "b.docx"), (b"", "")]
    out = spark.createDataFrame(rows, "c binary, n string").select(parse.sniff(F.col("c"), F.col("n")).alias("s")).select("s.*")
    assert [(r["detected_type"], r["strategy"]) for r in out.collect()] == [("unknown", "none"), ("pdf", "extension"), ("unknown", "none"), ("docx", "composite"), ("unknown", "none")]


def test_cleaning_composes_each_text_once(spark):
    from lodestone.operators import clean
    from lodestone.plans.engine import CLEANING

    rows = [("d", 0, "e\u0301 one"), ("d", 1, "\u00e9 one"), ("d", 2, " "), ("d", 3, None), ("d", 4, "Skip to content"), ("e", 0, "\u201cquoted\u201d")]
    out = clean.clean(spark.createDataFrame(rows, "doc_id string, pos int, text string"), CLEANING)
    assert sorted(map(tuple, out.collect())) == [("d", 0, "\u00e9 one"), ("e", 0, '"quoted"')]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
