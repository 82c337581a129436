"""What keeps queries within time and disk on large tables: work done once, and rows that stay where they are."""

import random
import re
from collections import Counter
from math import log

import pytest
from pyspark.sql import functions as F

from lodestone import queries
from lodestone.functions import text as T
from lodestone.operators import chunks, contain, keyword
from lodestone.operators.chunks import PRONOUNS


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_enrichment_reads_a_text_once_for_each_need(spark):
    rows = spark.createDataFrame([(1, "# A title\n\nIt is so. They are here.")], "chunk_id int, stable_text string")
    plan = optimized(chunks.enrich(rows).select("title", "summary", "tags", "risk_level"))
    assert plan.count("\\x{3002}") == 1  # sentences for title and summary
    assert plan.count("(?m)^#{1,6}") == 1  # the heading, tested and taken
    assert plan.count("[a-z]++") == 1  # words for tags and level
    anchored = optimized(chunks.annotate(spark.createDataFrame([("a",)], "text string")))
    assert anchored.count("(?m)^##\\s+") == 1


def test_pronouns_and_strip_on_odd_texts(spark):
    odd = ["It is it's ITS its_ it2 2it it", "été it été-it it…it they", "…it it… a……it IT́ it", "they them it she we", None, "", "İt it ıt ſhe she it", "it\x1fit　it it it\nthey"]
    odd += [f"{s}it is{s}" for s in T.SPACES] + [T.SPACES + "a" + T.SPACES, "​it​", "᠎ it ﻿", "𝒶it it 😀it it it it it"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "i int, t string")
    _, hits, words = chunks.pronoun_risk(F.col("t"))
    word = r"[^\W]"
    for r in rows.select("t", hits.alias("hits"), words.alias("words"), T.strip(F.col("t")).alias("s"), F.lower("t").alias("low")).collect():
        if r["t"] is None:
            assert (r["hits"], r["words"], r["s"]) == (None, None, None)
            continue
        left = re.sub(rf"{word}*[^\x00-\x7f]{word}*", " ", r["low"])
        plain = [w for w in re.findall(r"\w+", left) if re.fullmatch("[a-z]+", w)]
        assert r["words"] == len(plain), r["t"]
        assert r["hits"] == (sum(w in PRONOUNS for w in plain) if len(plain) >= 5 else 0), r["t"]
        assert r["s"] == r["t"].strip(T.SPACES) == r["t"].strip(), r["t"]


def nodes(df):
    return df._jdf.queryExecution().executedPlan().toString()


def plain_scores(docs, asked, k1=1.5, b=0.75):
    """BM25 spelt out over white-space separated words: (query, chunk) to score."""
    bags = {i: Counter(t.split()) for i, t in docs}
    df = Counter(w for bag in bags.values() for w in bag)
    raw = {w: log(len(bags) - n + 0.5) - log(n + 0.5) for w, n in df.items()}
    least, mean = 0.25 * sum(raw.values()) / len(raw), sum(sum(bag.values()) for bag in bags.values()) / len(bags)
    idf = {w: x if x >= 0 else least for w, x in raw.items()}
    out = {}
    for q, text in asked:
        for i, bag in bags.items():
            shared = [(w, n) for w, n in Counter(text.split()).items() if w in bag]
            if shared:
                out[q, i] = round(sum(n * idf[w] * bag[w] * (k1 + 1) / (bag[w] + k1 * (1 - b + b * sum(bag.values()) / mean)) for w, n in shared), 6)
    return out


def corpora():
    draw = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    some = lambda n: " ".join(draw.choices(words, weights=[60 / (i + 1) for i in range(60)], k=n))
    mixed = [(i, some(draw.randint(1, 60))) for i in range(700)] + [(1000 + i, "w1 w2 w3") for i in range(300)] + [(5000, "")]
    common = [(i, "all the same words" if i % 7 else "all the other words here") for i in range(40)]  # every weight is negative
    return {"mixed": (mixed, [(q, some(12)) for q in range(9)] + [(90, "nowhere"), (91, "w1 w2 w3"), (92, "w59 w59 w1")]), "common": (common, [(1, "all words"), (2, "other here")])}


@pytest.mark.parametrize("limits", [{}, {"TOGETHER": 7, "CELLS": 40, "QUERY_TERMS": 5, "QUERIES": 2, "SEGMENT": 500}], ids=["plain", "small"])
@pytest.mark.parametrize("corpus", ["mixed", "common"])
def test_scores_made_in_tasks_are_exact(spark, monkeypatch, corpus, limits):
    for name, value in limits.items():
        monkeypatch.setattr(keyword, name, value)
    docs, asked = corpora()[corpus]
    expected = plain_scores(docs, asked)
    rows, queries = spark.createDataFrame(docs, "chunk_id int, stable_text string").repartition(3), spark.createDataFrame(asked, "query_id int, query string")
    index = keyword.build(rows)
    blocks = keyword.term_blocks(index.forward)
    stored = keyword.KeywordIndex(index.forward, index.terms, index.corpus, blocks)
    count = lambda rows: sorted(map(tuple, rows.select("term", "chunk_id", "tf", "n_terms").collect()))
    assert count(blocks.select("term", F.explode("postings").alias("p")).select("term", "p.*")) == count(index.postings)
    for held in (index, stored):
        for k, scope in ((10, None), (400, None), (5, rows.where("chunk_id % 3 = 1").select("chunk_id"))):
            found = {}
            for r in keyword.search(held, queries, k, scope).orderBy("query_id", "rank").collect():
                found.setdefault(r["query_id"], []).append((r["chunk_id"], r["bm25_score"]))
            for q, _ in asked:
                best = sorted((-s, i) for (x, i), s in expected.items() if x == q and (scope is None or i % 3 == 1))[:k]
                assert [s for _, s in found.get(q, [])] == pytest.approx([-s for s, _ in best], abs=2e-6)
                assert [i for i, _ in found.get(q, [])] == [i for _, i in best]
    every = {q: sum(w in t.split() for w in set(text.split()) for _, t in docs) for q, text in asked}
    read = {r["query_id"]: (r["n_postings"], r["n_read"]) for r in keyword.postings_read(stored, queries, 3).collect()}
    assert all(every[q] == n >= m for q, (n, m) in read.items()) and set(read) == {q for q, n in every.items() if n}


def test_no_row_for_a_pair_is_shuffled(spark):
    """A search deals out only the best rows of each task, and blocks are made where the chunks lie."""
    docs, asked = corpora()["mixed"]
    index = keyword.build(spark.createDataFrame(docs, "chunk_id int, stable_text string"))
    plan = nodes(keyword.search(index, spark.createDataFrame(asked, "query_id int, query string"), 10))
    assert "Generate explode" not in plan and "HashAggregate" not in plan
    assert "Exchange" not in nodes(keyword.term_blocks(index.forward))


def test_what_several_uses_need_is_searched_once(spark, monkeypatch):
    made = []
    search = keyword.search
    monkeypatch.setattr(keyword, "search", lambda *a, **b: made.append(1) or search(*a, **b))
    for name in ("cited_filter", "token_saved", "answer_quality"):
        made.clear()
        out = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
        assert len(made) == 1 and "documents.parquet" not in nodes(out), name


def test_texts_come_to_few_pairs(spark):
    """The texts of pairs that are left are looked up by a scan, and none is dealt out."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100k")  # documents are larger, passages and pairs are not
    try:
        plan = nodes(queries._qrels(spark, "/root/testdata/sf0.001"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" not in plan and "documents.parquet" in plan


def test_minimizers_are_those_of_every_window():
    draw = random.Random(5)
    for t in range(400):
        raw = bytes(draw.choices(range(256) if t % 2 else b"ab", k=draw.randint(0, 150)))
        q, w = draw.randint(1, 20), draw.randint(1, 40)
        h = []
        for i in range(len(raw) - q + 1):
            x = 0
            for c in raw[i : i + q]:
                x = (x * int(contain.BASE) + c + 1) % (1 << 64)
            h.append((x ^ (x >> 31)) * int(contain.BASE) % (1 << 64))
        assert contain.hashes(raw, q).tolist() == h
        windows = [h[i : i + w] for i in range(max(1, len(h) - w + 1))] if h else []
        assert contain.minimizers(raw, q, w).tolist() == sorted({min(x) for x in windows})
