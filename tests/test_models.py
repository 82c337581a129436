"""Contracts of providers: order, tokens, errors, structured answers, rerankers by name."""

import pytest
from pyspark.sql import functions as F

from lodestone.operators import fusion, models, vectors


def test_vectors_come_back_to_their_texts(spark):
    rows = spark.createDataFrame([(i, f"{i}") for i in range(7)] + [(7, None)], "id int, stable_text string").coalesce(1)

    def provider(texts):
        made = [(k, [float(t or -1), 0.0]) for k, t in enumerate(texts)]
        return models.Embedded(made[::-1], 10 * len(texts))

    got = models.embed_with_usage(rows, provider, batch=3).orderBy("id").collect()
    assert [r["embedding"][0] for r in got] == [0.0, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, -1.0] and sum(r["embedding_tokens"] for r in got) == 80
    with pytest.raises(ValueError):
        models.embed_with_usage(rows.limit(0), provider)
    with pytest.raises(Exception, match="vectors for places"):
        models.embed_with_usage(rows, lambda texts: models.Embedded([(0, [1.0])], 1)).collect()


def test_structured_answers(spark):
    answers = {"a": 'Sure: {"name": "x", "n": 3} there', "b": "no json", "c": '{"name": "y"', "d": '{"name": "z", "other": 1}'}
    rows = spark.createDataFrame([(k,) for k in [*answers, None]], "user string")
    got = {r["user"]: r["answer"] for r in models.complete_structured(rows, lambda prompts: [answers[p] for p in prompts], "name string, n int").collect()}
    assert (got["a"]["name"], got["a"]["n"]) == ("x", 3) and (got["d"]["name"], got["d"]["n"]) == ("z", None)
    assert got["b"] is None and got["c"] is None and got[None] is None


def test_rerankers_by_name(spark):
    rows = spark.createDataFrame([(1, "a", 1, 0.5, "q", "q"), (1, "b", 2, 0.4, "q", "x")], "query_id int, chunk_id string, rank int, rrf_score double, query string, stable_text string")
    fusion.register_reranker("backwards", lambda candidates, top, weight=1.0: fusion.rerank(candidates, -F.col("rrf_score") * weight, top))
    try:
        order = lambda r: [x["chunk_id"] for x in sorted(r(rows, 2).collect(), key=lambda x: x["rank"])]
        assert order(fusion.build_reranker("backwards", weight=2.0)) == ["b", "a"]
        assert order(fusion.build_reranker("backwards", colour="red")) == order(fusion.build_reranker("unknown")) == ["a", "b"]
    finally:
        del fusion.RERANKERS["backwards"]


def test_strict_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0]), (2, None)], "chunk_id int, embedding array<float>")
    assert vectors.checked(rows).count() == 1
    with pytest.raises(Exception, match="needs an id"):
        vectors.checked(rows, strict=True).collect()
