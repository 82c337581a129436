"""The bucketed store: what a save writes, what concurrent writers leave, and what readers see."""

import threading

import pytest
from pyspark.sql import functions as F

from lodestone.operators.store import Conflict, Store


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store", buckets=8)


def documents(spark, ids, mark="x"):
    return spark.createDataFrame([(i, mark) for i in ids], "doc_id string, text string")


def held(store, name="documents"):
    return sorted(tuple(r) for r in store.read(name).collect())


def test_a_save_writes_only_the_buckets_of_its_keys(spark, store, tmp_path):
    store.save("documents", documents(spark, [f"d{i}" for i in range(400)]))
    before = {p for p in (tmp_path / "store").rglob("*.parquet")}
    assert len(store.snapshot().tables["documents"]["segments"][0]["buckets"]) == 8
    store.save("documents", documents(spark, ["d7", "new"], "y"))
    fresh = [p for p in (tmp_path / "store").rglob("*.parquet") if p not in before]
    assert 1 <= len(fresh) <= 2 and before <= set((tmp_path / "store").rglob("*.parquet"))
    rows = dict(held(store))
    assert len(rows) == 401 and rows["d7"] == rows["new"] == "y" and rows["d8"] == "x"
    untouched = store.snapshot()
    plan = untouched.read("documents", set(range(8)) - set(untouched.tables["documents"]["segments"][1]["buckets"]))._jdf.queryExecution().toString()
    assert "Join" not in plan  # buckets without later rows are plain scans


def test_concurrent_writers_both_survive(spark, store):
    store.save("documents", documents(spark, ["a"]))
    failed = []

    def write(i):
        try:
            store.save("documents", documents(spark, [f"t{i}"]))
        except Conflict as e:
            failed.append(e)

    threads = [threading.Thread(target=write, args=(i,)) for i in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert [r[0] for r in held(store)] == ["a", *[f"t{i}" for i in range(6)]] and not failed


def test_two_writers_on_one_ground(spark, tmp_path):
    """Both read the same manifest; the second commits on top of the first, and never over it."""
    one, two = (Store(spark, f"file://{tmp_path}/store") for _ in range(2))
    one.save("documents", documents(spark, ["a"]))
    b, c = one.stage("documents", documents(spark, ["b"])), two.stage("documents", documents(spark, ["c"]))
    two.commit([c])
    one.commit([b])
    assert [r[0] for r in held(two)] == ["a", "b", "c"]
    assert not one._add(one._manifest(0), "{}")
    blocked = Store(spark, f"file://{tmp_path}/store", tries=2)
    blocked._add = lambda path, text: False
    with pytest.raises(Conflict):
        blocked.save("documents", documents(spark, ["d"]))


def test_readers_see_one_commit_of_all_tables(spark, store):
    rows = spark.createDataFrame([("a", 0, "h0"), ("a", 1, "h1")], "doc_id string, sequence int, block_hash string")
    store.commit([store.stage("documents", documents(spark, ["a"])), store.stage("blocks", rows)])
    before = store.snapshot()
    store.delete(documents(spark, ["a"]))
    assert store.read("documents").count() == 0 and store.read("blocks").count() == 0
    assert before.read("documents").count() == 1 and before.read("blocks").count() == 2
    store.save("documents", documents(spark, ["a"], "again"))
    assert held(store) == [("a", "again")] and store.read("blocks").count() == 0


def test_compaction_keeps_the_rows(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store", buckets=3, segments=3)
    want = {}
    for i in range(12):
        ids = [f"d{(7 * i + j) % 20}" for j in range(4)]
        store.save("documents", documents(spark, ids, f"v{i}"))
        want |= dict.fromkeys(ids, f"v{i}")
        if i % 5 == 4:
            store.delete(documents(spark, ids[:1]))
            want.pop(ids[0])
        assert dict(held(store)) == want
    assert max(len(t["segments"]) for t in store.snapshot().tables.values()) <= 5


def test_lookup_skips_buckets_and_row_groups(spark, tmp_path):
    """A few keys: one bucket's files are listed, and filters reach the scan for its Bloom filter."""
    store = Store(spark, f"file://{tmp_path}/store", buckets=4)
    rows = spark.range(20_000).select(F.sha2(F.col("id").cast("string"), 256).alias("doc_id"), F.col("id").alias("n"))
    store.save("documents", rows)
    key = rows.where("n = 77").first()["doc_id"]
    found = store.snapshot().lookup("documents", [key])
    assert [r["n"] for r in found.collect()] == [77] and len({f.split("__bucket=")[1][0] for f in found.inputFiles()}) == 1
    assert "PushedFilters: [In(doc_id" in found._jdf.queryExecution().toString() or "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id" in found._jdf.queryExecution().toString()
    none = store.snapshot().lookup("documents", ["of no row"])
    assert none.count() == 0


def test_rows_without_keys_and_empty_saves(spark, store):
    store.save("documents", documents(spark, []))
    assert store.exists("documents") and held(store) == [] and store.read("blocks") is None
    store.save("documents", documents(spark, ["a", None]))
    store.save("documents", documents(spark, [None], "later"))
    assert {tuple(r) for r in store.read("documents").collect()} == {("a", "x"), (None, "later")}


def test_former_versions_and_newest_first(spark, store):
    assert store.latest_first() is None
    rows = lambda i: spark.createDataFrame([(f"d{i}", f"p{i}", i)], "doc_id string, source_path string, n int").withColumn("ingested_at", F.lit(i).cast("timestamp"))
    for i in (2, 1, 3):
        store.save("documents", rows(i))
    assert [r["doc_id"] for r in store.latest_first().collect()] == ["d3", "d2", "d1"]
    store.save("blocks", spark.createDataFrame([("d1", 0, "old")], "doc_id string, sequence int, block_hash string"))
    store.save("blocks", spark.createDataFrame([("d1", 0, "new")], "doc_id string, sequence int, block_hash string"))
    wanted = spark.createDataFrame([("d1",)], "doc_id string")
    assert [store.snapshot(back).of("blocks", wanted).first()["block_hash"] for back in (0, 1)] == ["new", "old"]
    assert store.snapshot(2).read("blocks") is None and store.snapshot(99).number == -1
