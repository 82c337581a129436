"""Exact neighbours by pivots against brute force on data of several shapes."""

import math

import numpy as np
import pytest

from lodestone.operators import vectors

SCHEMA = "chunk_id int, embedding array<float>, label int"


def clustered(rng, n, dim):
    return rng.normal(size=(12, dim))[rng.integers(0, 12, n)] + rng.normal(size=(n, dim)) * 0.05


def circular(rng, n, dim):
    turn = rng.uniform(0, 2 * math.pi, n)
    return np.stack([np.cos(turn), np.sin(turn)], 1) @ np.linalg.qr(rng.normal(size=(dim, 2)))[0].T


def uniform(rng, n, dim):
    return rng.uniform(size=(n, dim))


def repeated(rng, n, dim):
    return rng.normal(size=(5, dim))[rng.integers(0, 5, n)]


def brute(x, labels, asked, k, same):
    out = {}
    for q in asked:
        d = np.round(((x.astype(np.float64) - x[q].astype(np.float64)) ** 2).sum(1), 6)
        fits = [i for i in range(len(x)) if not same or labels[i] == labels[q]]
        out[q] = sorted((d[i], i) for i in fits)[:k]
    return out


@pytest.mark.parametrize("same", [None, "label"])
@pytest.mark.parametrize("make", [clustered, circular, uniform, repeated])
def test_neighbours_are_exact(spark, make, same):
    rng = np.random.default_rng(3)
    x = make(rng, 1500, 12).astype(np.float32)
    labels = rng.integers(0, 4, 1500)
    df = spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, labels, strict=True))], SCHEMA).repartition(3)
    asked = df.where("chunk_id % 100 = 0").withColumnRenamed("chunk_id", "query_id")
    want = brute(x, labels, range(0, 1500, 100), 7, same)
    found = {}
    for r in vectors.search(df, asked, 7, block=200, same=same).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["chunk_id"], r["l2sq"]))
    for q, rows in found.items():
        assert [(d, i) for _, i, d in sorted(rows)] == [(pytest.approx(d), i) for d, i in want[q]], q
    assert set(found) == set(want)
    if make is clustered:
        seen = vectors.reach(df, asked, 7, block=200, same=same).collect()
        assert len(seen) == 15 and sum(r["n_met"] for r in seen) < 0.5 * sum(r["n_vectors"] for r in seen)


def test_odd_vectors_with_pivots(spark):
    rows = [(i, [float(i % 50), 1.0], 0) for i in range(300)] + [(900, None, 0), (901, [1.0, None], 0), (902, [float("nan"), 1.0], 0), (903, [1.0], 0), (904, [1.0, 1.0], None), (905, [], 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    asked = spark.createDataFrame([(1, [1.0, 1.0], 0), (2, [1.0], 0), (3, [1.0, 2.0, 3.0], 0), (4, [1.0, 1.0], None), (5, None, 0)], "query_id int, embedding array<float>, label int")
    found = {}
    for r in vectors.search(df, asked, 3, block=100, same="label").collect():
        found.setdefault(r["query_id"], []).append(r["chunk_id"])
    assert {q: sorted(c) for q, c in found.items()} == {1: [1, 51, 101], 2: [903]}
    assert vectors.search(df.limit(0), asked, 3).count() == 0 and vectors.search(df, asked.limit(0), 3).count() == 0
