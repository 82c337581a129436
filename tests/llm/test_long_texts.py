"""Texts of millions of characters: the operators read them whole and within a common worker's memory."""

import random
from pathlib import Path

from pyspark.sql import functions as F

from lodestone.llm import license_scan, quality_classifier, quality_rules

MIT = (Path(license_scan.__file__).parent / "licenses/MIT.txt").read_text()


def words(n, seed=1):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(5000)}" for _ in range(n))


def test_a_license_deep_inside_a_long_text(spark):
    docs = spark.createDataFrame([(1, words(300_000) + "\n\n" + MIT + "\n\n" + words(1000, 2)), (2, words(300_000, 3))], "doc_id long, text string")
    found = license_scan.scan(docs, threshold=0.8).collect()
    assert {r["doc_id"] for r in found} == {1} and any("MIT" in str(tuple(r)) for r in found)


def test_scores_and_rules_of_long_texts(spark):
    labelled = [(i, ("Good text of full sentences, with words. " * (5 + i % 7)) if i % 2 else "$$ ## || " * (20 + i % 9), "en") for i in range(300)]
    docs = spark.createDataFrame([*labelled, (900, words(400_000), "en"), (901, "x" * 3_000_000, "en"), (902, None, "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(300)], "doc_id long, quality int, toxic int")
    model = quality_classifier.fit(docs, labels)
    scored = {r["doc_id"]: r["score"] for r in quality_classifier.score(docs, model).where("doc_id >= 900").collect()}
    assert set(scored) == {900, 901, 902} and all(0 <= s <= 1 for s in scored.values())
    measured = {r["doc_id"]: r for r in quality_rules.ledger(docs).where(F.col("doc_id") >= 900).collect()}
    assert measured[900]["n_words"] == 400_000 and measured[901]["n_words"] == 1 and measured[901]["word_chars"] == 3_000_000
