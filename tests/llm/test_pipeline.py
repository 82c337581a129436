"""The pipeline's stages and the registered queries on the smallest tables."""

import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from lodestone.llm import near_text, queries, quality_rules, simhash

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == columns, name
        if name == "quality_rules":
            kept = {r["doc_id"] for r in quality_rules.apply_policy(quality_rules.ledger(docs)).where("kept").collect()}
            assert {r["doc_id"] for r in out.collect()} == kept and len(kept) < docs.count()
        if name == "near_dedup":
            rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
            label, _ = plain_groups([t for _, t in rows])
            assert {r["doc_id"] for r in out.collect()} == {rows[k][0] for k in label}
        if name == "passage_dedup":
            assert out.agg(F.sum(F.octet_length("text"))).first()[0] < docs.agg(F.sum(F.octet_length("text"))).first()[0]
        docs = out.cache()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == {r["doc_id"] for r in docs.collect()}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_covers_its_table(spark, name):
    out = queries.QUERIES[name](spark, SF)
    tables = {"vec_id": "embeddings", "conv_id": "conversations", "doc_id": "documents"}
    key = next(k for k in tables if k in out.columns)
    whole = spark.read.parquet(f"{SF}/{tables[key]}.parquet").select(key)
    if name != "op1_license_scan":
        assert whole.join(out.select(key).distinct(), key, "left_anti").count() == 0


def planted(seed=1, bases=12, n_words=200):
    """Bases of random words and copies of each with some words replaced."""
    rng = random.Random(seed)
    out = []
    for _ in range(bases):
        words = [f"w{rng.randrange(10**6)}" for _ in range(n_words)]
        out.append(" ".join(words))
        for edits in (1, 2, 3, 4, 6, 9):
            copy = list(words)
            for k in rng.sample(range(n_words), edits):
                copy[k] = f"v{rng.randrange(10**6)}"
            out.append(" ".join(copy))
    return out


def plain_groups(texts):
    sets = []
    for t in texts:
        words = (t or "").encode().translate(simhash._LOWER).split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))})
    label = list(range(len(texts)))
    pairs = [(i, j) for j in range(len(texts)) for i in range(j) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    for _ in texts:
        for i, j in pairs:
            label[i] = label[j] = min(label[i], label[j])
    return label, len(pairs)


@pytest.mark.parametrize("block", [512, 3])
def test_near_copies_of_similarity_0_8_go(spark, block):
    texts = planted()
    label, n_pairs = plain_groups(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r["doc_id"] for r in near_text.one_of_each(docs, block=block).collect()}
    assert kept == set(label) and n_pairs > 60 and len(kept) < len(texts)
    if block == 512:
        assert {r["doc_id"] for r in corpus_pipeline.near_dedup_stage(spark, docs, SF).collect()} == kept


def test_near_dedup_tells_rows_by_text(spark):
    rows = [(1, "a b c d e f g"), (1, "h i j k l m n"), (None, "a b c d e f g"), (None, "o p q r s t u"), (None, "o p q r s t u"), (2, None), (3, "")]
    out = near_text.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r["doc_id"] or 0), r["text"] or "") for r in out) == [(0, "o p q r s t u"), (1, "a b c d e f g"), (1, "h i j k l m n"), (2, "")]


def test_stages_leave_clashing_columns_and_repeated_ids_alone(spark):
    """Columns named like measures come back untouched, and no unrelated text of a shared or missing id is lost."""
    rng = random.Random(7)
    words = "river stone walks slowly under the tall trees where small birds sing before evening comes again".split()
    prose = lambda n: " ".join(rng.choice(words) + rng.choice(["", "", "s", "."]) for _ in range(n))
    texts = [prose(90) for _ in range(6)]
    rows = [(5, texts[0]), (5, texts[1]), (None, texts[2]), (None, texts[3]), (6, texts[4]), (6, texts[4]), (7, texts[5]), (8, None), (9, "")]
    rows = [(i, t, f"keep {k}", k, k / 7, True, f"s{k}", 3, k) for k, (i, t) in enumerate(rows)]
    schema = "doc_id long, text string, kept string, n_words int, quality_score double, failed_bits boolean, kept_sha256 string, N_BYTES int, __key int"
    docs = spark.createDataFrame(rows, schema)
    everything = {r[2]: tuple(r)[2:] for r in rows}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        held = out.collect()
        assert all(everything[r["kept"]] == tuple(r)[2:] for r in held), name
        if name == "near_dedup":
            assert sorted((r["doc_id"] or 0, r["text"] or "") for r in held) == sorted({(i or 0, t or "") for i, t, *_ in rows if i != 9})
        if name in ("quality_classifier", "passage_dedup"):
            assert len(held) == len(rows) or name == "quality_classifier"
        if name == "quality_rules":
            assert {r["text"] for r in held} <= set(texts)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == len(rows)
    assert corpus_pipeline.rule_stage(spark, docs.where("false"), SF).count() == 0


def test_short_texts_at_the_edge_link(spark):
    """Four of five shingles in common: fingerprints of so few hashes may differ in any number of bits."""
    rng = random.Random(17)
    rows = []
    for i in range(300):
        words = [f"w{rng.randrange(10**6)}" for _ in range(9)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[:8]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(r["doc_id"] for r in near_text.one_of_each(docs, similarity=0.8, shingle_words=5).collect())
    assert kept == [2 * i for i in range(300)]


def test_long_texts_near_each_other(spark):
    rng = random.Random(19)
    long = " ".join(f"w{rng.randrange(10**5)}" for _ in range(60_000))
    rows = [(1, long), (2, long + " and a tail"), (3, long[: len(long) // 2]), (4, None), (5, "")]
    kept = sorted(r["doc_id"] for r in near_text.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert kept == [1, 3, 4]
