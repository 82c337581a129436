"""Passages held whole by texts, against brute force."""

import random

from lodestone.operators import contain


def test_pairs_equal_brute_force(spark):
    rng = random.Random(9)
    words = ["alpha", "b", "ça", "日本", "  ", "\n", "xyz", "aaaa", "0"]
    texts = ["".join(rng.choice(words) for _ in range(rng.randrange(120))) for _ in range(150)] + ["a" * 90_000, "", None, "ab" * 200]
    passages = [None, "", "a", "ça", "日", "aaaa" * 30, "not there at all, anywhere in it", "ab" * 90, "a" * 70_000]
    for _ in range(120):
        t = rng.choice(texts[:150])
        i = rng.randrange(max(1, len(t)))
        passages.append(t[i : i + rng.choice([1, 3, 7, 15, 16, 30, 46, 47, 200])])
    passages += [p + "!" for p in passages[20:40] if p]
    left = spark.createDataFrame(list(enumerate(texts)), "chunk_id int, body string").repartition(3)
    right = spark.createDataFrame(list(enumerate(passages)), "query_id int, passage string")
    found = contain.containing(left, right)
    assert "NestedLoop" not in found._jdf.queryExecution().toString() and "Cartesian" not in found._jdf.queryExecution().toString()
    got = [tuple(r) for r in found.collect()]
    want = {(q, c) for q, p in enumerate(passages) if p for c, t in enumerate(texts) if t is not None and p in t}
    assert len(got) == len(set(got)) and set(got) == want
    assert contain.containing(left.limit(0), right).count() == 0 and contain.containing(left, right.limit(0)).count() == 0


def test_minimizers_of_a_part_are_those_of_the_whole():
    rng = random.Random(2)
    whole = bytes(rng.randrange(97, 100) for _ in range(200_000))
    every = set(contain.minimizers(whole, 16, 32).tolist())
    for _ in range(50):
        i = rng.randrange(len(whole) - 60)
        assert set(contain.minimizers(whole[i : i + rng.randrange(47, 60)], 16, 32).tolist()) <= every
