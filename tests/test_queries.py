"""Registered queries against their SQL on the smallest tables."""

import re
from collections import Counter
from math import log

import duckdb
import pytest

import __spark_entry__
from lodestone import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHOSEN = ["blocks_split", "clean_ocr_merge", "markdown_blocks", "chunk_build", "block_diff", "resync_window", "bm25_topk", "bm25_filled", "early_skip", "rrf_fusion", "context_pack", "latency_mean_p95", "html_main_text", "bm25_pruned", "knn_topk", "knn_topk_filtered", "knn_pivots", "layout_paragraphs", "eval_macro", "answer_spans", "clean_unicode", "language_filter", "keyword_remove", "bm25_statistics"]


def plain(value):
    return repr(round(value, 9)) if isinstance(value, float) else repr(value)


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert {"hybrid_search", "bm25_topk"} <= set(queries.QUERIES)


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for table in TABLES:
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    out = queries.QUERIES[name](spark, SF)
    columns = sorted(out.columns)
    expected = con.sql(queries.ORACLE_SQL[name])
    assert sorted(expected.columns) == columns
    places = [expected.columns.index(c) for c in columns]
    theirs = sorted(tuple(plain(row[i]) for i in places) for row in expected.fetchall())
    assert sorted(tuple(plain(v) for v in row) for row in out.select(*columns).collect()) == theirs


def test_scans_are_pruned(spark):
    plan = queries.QUERIES["list_collections"](spark, SF)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<lang:string>" in plan
    plan = queries.QUERIES["runs_latest"](spark, SF)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan and "EqualTo(event_type,purchase)" in plan


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_whole_passages_are_searched(spark):
    """bm25_topk against BM25 spelt out over every term of every passage."""
    con = duckdb.connect()
    bag = lambda text: Counter(re.findall(r"\w+", (text or "").lower()))
    docs = {i: bag(t) for i, t in con.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()}
    asked = con.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()
    df = Counter(w for d in docs.values() for w in d)
    raw = {w: log(len(docs) - n + 0.5) - log(n + 0.5) for w, n in df.items()}
    floor = 0.25 * sum(raw.values()) / len(raw)
    length = {i: sum(d.values()) for i, d in docs.items()}
    mean = sum(length.values()) / len(docs)
    expected = {}
    for q, text in asked:
        assert len(text) > 60
        for i, d in docs.items():
            hits = [(n, w) for w, n in bag(text).items() if w in d]
            if hits:
                part = [n * (raw[w] if raw[w] >= 0 else floor) * d[w] * 2.5 / (d[w] + 1.5 * (0.25 + 0.75 * length[i] / mean)) for n, w in hits]
                expected[q, i] = sum(part)
    found = queries.QUERIES["bm25_topk"](spark, SF).collect()
    assert len(found) == sum(min(10, sum(q == k[0] for k in expected)) for q, _ in asked)
    for r in found:
        assert r["bm25_score"] == pytest.approx(expected[r["query_id"], r["chunk_id"]], abs=2e-6)
        above = sum(v > r["bm25_score"] + 2e-6 for (q, _), v in expected.items() if q == r["query_id"])
        assert above < r["rank"]
