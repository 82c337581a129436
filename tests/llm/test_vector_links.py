"""Links of near-duplicate vectors where neighbours do not lie in random directions, with default arguments."""

import math

import numpy as np
import pytest

from lodestone.llm import vector_dedup

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(raw, cosine=0.98):
    """Links of each row, by exact cosine in double precision."""
    x = raw.astype(np.float64)
    norm = np.sqrt((x * x).sum(1))
    unit = x / norm[:, None]
    return np.array([int((unit @ unit[i] >= cosine).sum()) - 1 for i in range(len(x))])


def circle(n, dim, seed=3):
    rng = np.random.default_rng(seed)
    plane = np.linalg.qr(rng.normal(size=(dim, 2)))[0]
    turn = rng.uniform(0, 2 * math.pi, n)
    return (np.stack([np.cos(turn), np.sin(turn)], 1) @ plane.T).astype(np.float32)


def clustered(n, dim, seed=5):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(40, dim))
    return (centres[rng.integers(0, 40, n)] + rng.normal(size=(n, dim)) * 0.09).astype(np.float32)


def uniform(n, dim, seed=7):
    return np.random.default_rng(seed).normal(size=(n, dim)).astype(np.float32)


@pytest.mark.parametrize("make, n, dim", [(circle, 6000, 256), (circle, 6000, 64), (clustered, 4000, 48), (uniform, 4000, 4)])
def test_no_link_is_lost_in_any_direction(spark, make, n, dim):
    raw = make(n, dim)
    rows = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(raw)], SCHEMA).repartition(4)
    got = {r["vec_id"]: r["n_links"] for r in vector_dedup.near_duplicates(rows, list_rows=256).collect()}
    want = brute(raw)
    missing = int(sum(max(0, want[i] - got[i]) for i in range(n)))
    assert want.sum() > 1000 and [got[i] for i in range(n)] == want.tolist(), f"{missing} of {want.sum()} links are missing"


def test_a_table_without_any_vector(spark):
    rows = spark.createDataFrame([(1, None, 1), (2, None, None), (3, [], 1), (4, [0.0, 0.0], 1)], SCHEMA)
    assert sorted(map(tuple, vector_dedup.near_duplicates(rows).collect())) == [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 0, 4)]
