"""Operators against plain versions on small tables with hostile rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestone.llm import (
    bpe,
    common,
    license_scan,
    packing,
    passage_dedup,
    quality_classifier,
    quality_rules,
    sharding,
    simhash,
    token_counts,
    vector_dedup,
)

SCHEMA = "doc_id long, text string, lang string, size long, score double, kept boolean"
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def texts():
    """Nulls, empty and very long texts, copies, near copies, shared passages and odd characters."""
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "straße", "Été", "x", "42", "don't", "a|b", "日本語", "#tag"]
    base = [" ".join(rng.choice(words) + str(rng.randrange(40)) for _ in range(rng.randrange(1, 120))) for _ in range(25)]
    passage = "This one passage of well over fifty bytes is shared by several of these documents."
    out = [*base, base[0], base[0], base[1] + " tail", base[2].upper(), "head " + passage, passage + " end", "mid " + passage + " mid", None, None, "", " \n\t ", "one"]
    out += ["line\nline\nline\n\nother", "Released under the MIT License.\nwords", "a" * 3000, "ab " * 9000, passage * 3, "a\r\nb  c   d \x1c e\x85f", "<|endoftext|> x"]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", 5, 0.5, True) for i, t in enumerate(texts())]
    rows.append(rows[3])  # a repeated row
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def plain_documents():
    return list(enumerate(texts()))


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (4, 6), (7, 7), (9, 8), (8, 9), (None, 3)] + [(100 + i, 101 + i) for i in range(60)] + [(300, 301 + i) for i in range(50)]
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {1, 2, 3} == {n for n, c in got.items() if c == 1} and {n for n, c in got.items() if c == 4} == {4, 5, 6}
    assert all(got[100 + i] == 100 for i in range(61)) and got[350] == 300 and 7 not in got


def test_quality_rules(spark, docs):
    rows = quality_rules.apply_policy(quality_rules.ledger(docs)).collect()
    assert len(rows) == docs.count() and "lang" in rows[0].asDict()
    by_id = {r["doc_id"]: r for r in rows}
    for i, t in plain_documents():
        t = t or ""
        w = WORDS.findall(t)
        grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        often, covered = Counter(grams), set()
        for k, g in enumerate(grams):
            if often[g] > 1:
                covered |= {k, k + 1, k + 2}
        lines = [x for x in t.split("\n") if WORDS.search(x)]
        r = by_id[i]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"], r["n_dup_lines"]) == (len(w), sum(map(len, w)), len(covered), len(lines) - len(set(lines)))
        assert r["n_symbols"] == sum(t.count(c) for c in "#*$%&|<>")
        assert r["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert not (r["base_failed"] and r["kept"])
    ablated = {r["rule"]: r for r in quality_rules.ablation(quality_rules.ledger(docs)).collect()}
    assert ablated["few_words"]["n_failed"] >= ablated["few_words"]["n_failed_alone"]
    assert quality_rules.ledger(empty(spark)).count() == 0


def test_sharding(spark, docs):
    rows = sharding.shard(docs, n_shards=4, rows_per_bucket=3).collect()
    assert len(rows) == docs.count()
    slots = defaultdict(list)
    size = {i: len((t or "").encode()) + 16 for i, t in plain_documents()}
    crc = {i: zlib.crc32((t or "").encode()) for i, t in plain_documents()}
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        assert r["size"] == size[r["doc_id"]] and r["text_crc32"] == crc[r["doc_id"]]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(4))
    assert sharding.shard(empty(spark)).count() == 0


def test_splitters_are_near_equal(spark):
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "copy").otherwise(F.col("id").cast("string")).alias("text"))
    held = sharding.shard(rows, 40).groupBy("shard").agg(F.sum("size").alias("b")).collect()
    assert len(held) == 40 and max(r["b"] for r in held) < 1.01 * min(r["b"] for r in held)


@pytest.mark.parametrize("doc_id", ["1", "NULL", "id % 3"])
def test_repeated_rows_are_spread_evenly(spark, doc_id):
    """Half of the rows repeat one id and text (or have no id): every shard still gets its share, slots without gaps."""
    rows = spark.range(800).selectExpr(f"if(id < 400, cast({doc_id} as bigint), id) AS doc_id", "if(id < 400, 'one text of some length', concat('text ', id)) AS text")
    held = defaultdict(list)
    for r in sharding.shard(rows, 8, rows_per_bucket=30).collect():
        held[r["shard"]].append((r["size"], r["slot"]))
    sizes = [sum(b for b, _ in rows) for rows in held.values()]
    assert len(held) == 8 and max(sizes) - min(sizes) <= 2 * max(b for rows in held.values() for b, _ in rows)
    assert all(sorted(n for _, n in rows) == list(range(len(rows))) for rows in held.values())


def test_splitters_are_those_of_a_sort(spark):
    rows = common.cut(sharding.sized(spark.range(3000).selectExpr("id AS doc_id", "repeat('x', cast(id % 97 as int)) AS text")))
    ordered = sorted((r["key"], r["size"]) for r in rows.collect())
    total, below, at = sum(b for _, b in ordered), 0, 0
    for i, splitter in enumerate(sharding.find_splitters(rows, 12), 1):
        while at < len(ordered) and ordered[at][0] < splitter:
            below += ordered[at][1]
            at += 1
        assert abs(below - total * i / 12) <= max(b for _, b in ordered) + total / 12 * 0.001


def plain_fingerprint(text):
    w = WORDS.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    shingles = [" ".join(w[k : k + 4]) for k in range(len(w) - 3)] if len(w) >= 4 else ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(fps, radius):
    label = list(range(len(fps)))
    for _ in fps:
        for a in range(len(fps)):
            near = [b for b in range(len(fps)) if (fps[a] ^ fps[b]).bit_count() <= radius]
            least = min(label[b] for b in near)
            for b in near:
                label[b] = least
    return label


def test_simhash(spark, docs):
    rows = simhash.near_duplicates(docs).collect()
    fps = [plain_fingerprint(t) for _, t in plain_documents()]
    groups = plain_groups(fps, 4)
    assert len(rows) == docs.count()
    for r in rows:
        assert r["fp"] & (2**64 - 1) == fps[r["doc_id"]] and r["component_id"] == groups[r["doc_id"]]
    assert simhash.near_duplicates(empty(spark)).count() == 0


@pytest.mark.parametrize("block", [2, 16, 1024])
def test_simhash_links_lose_nothing(spark, block):
    rng = random.Random(block)
    centre = [rng.getrandbits(64) for _ in range(4)]
    fps = list(dict.fromkeys(c ^ sum({1 << rng.randrange(64) for _ in range(rng.randrange(5))}) for c in centre for _ in range(30)))
    table = common.cut(spark.createDataFrame([(f - (f >> 63 << 64), i) for i, f in enumerate(fps)], "fp long, rep long"))
    got = {r["node"]: r["component"] for r in common.components(simhash.links(table, 4, block)).collect()}
    assert [got.get(i, i) for i in range(len(fps))] == plain_groups(fps, 4)


def test_bit_slices():
    rng = np.random.default_rng(1)
    lanes = rng.integers(0, 1 << 63, 130, dtype=np.uint64)
    asked = lanes[:70] ^ (np.uint64(1) << rng.integers(0, 63, 70, dtype=np.uint64))
    for radius in (0, 1, 4, 7):
        bits = np.unpackbits(simhash.within(asked, simhash.planes(lanes), 130, radius).view(np.uint8), axis=1, bitorder="little")[:, :130]
        assert (bits == (np.bitwise_count(asked[:, None] ^ lanes[None]) <= radius)).all()


def plain_removal(rows, width=50):
    seen, out = {}, {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        windows = [b[k : k + width] for k in range(len(b) - width + 1)]
        for k, w in enumerate(windows):
            if w in seen:
                gone[k : k + width] = b"\1" * width
        for w in windows:
            seen.setdefault(w, i)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out[i] = (len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize(("batch", "shard"), [(1 << 20, 1 << 20), (900, 3000)])
def test_passages(spark, docs, batch, shard):
    out = passage_dedup.remove_repeats(docs, 50, batch_bytes=batch, shard_bytes=shard, stretch_runs=shard // 1000)
    assert out.columns == [*docs.columns, "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    expected = plain_removal(plain_documents())
    rows = out.collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == expected[r["doc_id"]]
    assert passage_dedup.remove_repeats(empty(spark)).count() == 0


def test_frequent_phrase_is_dealt_over_buckets(spark, monkeypatch):
    """A phrase of 33 bytes between new neighbours in every document: no task refines the strings of all."""
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    rows = [(i, f"{word(40)} one frequent phrase of this corpus {word(40)}") for i in range(300)]
    rows += [(300 + i, rows[i][1][5:] + word(9)) for i in range(20)]
    real = passage_dedup._refine_shard

    def bounded(width):
        refine = real(width)

        def run(pending, spelt):
            assert sum(map(len, spelt.column("number").to_pylist())) // 16 <= 40
            return refine(pending, spelt)

        return run

    monkeypatch.setattr(passage_dedup, "_refine_shard", bounded)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    expected = plain_removal(rows)
    for r in passage_dedup.remove_repeats(df, 50, batch_bytes=4000, shard_bytes=2000, gram_runs=40).collect():
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == expected[r["doc_id"]]


def test_refinement_names_windows():
    rng = random.Random(5)
    text = "".join(rng.choice("ab") for _ in range(400)) * 2
    starts = np.arange(len(text) - 50)
    names = passage_dedup.refine(np.frombuffer(text.encode(), np.uint8), starts, 50)
    by_window = defaultdict(set)
    for s in starts:
        by_window[text[s : s + 50]].add(int(names[s]))
    assert all(len(v) == 1 for v in by_window.values()) and len({min(v) for v in by_window.values()}) == len(by_window)


def test_bpe(spark, docs):
    tokenizer = Tokenizer.from_file(BYTE_BPE)
    rows = {r["doc_id"]: r for r in bpe.digests(docs, BYTE_BPE).collect()}
    for i, t in plain_documents():
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        r = rows[i]
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
    assert {r["doc_id"]: r["decoded"] for r in bpe.encode_documents(docs, BYTE_BPE).collect()} == {i: t or "" for i, t in plain_documents()}
    assert bpe.digests(empty(spark), BYTE_BPE).count() == 0


def test_bpe_and_word_ids_on_random_strings():
    rng = random.Random(9)
    parts = ["a", "B", "th", " ", "  ", "\n", "\t", "'s", "'", "é", "ß", "Ñ", "12", "!", "...", "\x1c", "\x85", "\xa0", "日", "😀", "\0", "aaaa", "́", "²", "İ", "Σ", "_", "<|endoftext|>"]
    for path, encode in ((BYTE_BPE, bpe.Bpe(open(BYTE_BPE).read()).encode), (WORD_BPE, lambda x, w=packing.WordIds(open(WORD_BPE).read()): np.frombuffer(w.encode(x), "<u4"))):
        tokenizer = Tokenizer.from_file(path)
        for _ in range(1500):
            x = "".join(rng.choice(parts) for _ in range(rng.randrange(25)))
            assert encode(x).tolist() == tokenizer.encode(x, add_special_tokens=False).ids


def test_packing(spark, docs):
    rows = packing.pack(docs, WORD_BPE, capacity=256, rows_per_bucket=5).collect()
    tokenizer = Tokenizer.from_file(WORD_BPE)
    expected = Counter()
    for i, t in [*plain_documents(), plain_documents()[3]]:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for k, a in enumerate(range(0, len(ids), 256)):
            expected[(i, k, a, len(ids[a : a + 256]), zlib.crc32(ids[a : a + 256].tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == expected
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 256
    assert packing.pack(empty(spark), WORD_BPE).count() == 0


def fewest_bins(counts, capacity):
    """A lower bound: above capacity - k each needs a bin that holds nothing of k or more; the rest share what is free."""
    best = -(-sum(n * c for n, c in counts.items()) // capacity)
    for k in range(1, capacity // 2 + 1):
        alone = sum(c for n, c in counts.items() if n > capacity - k)
        half = {n: c for n, c in counts.items() if capacity < 2 * n and n <= capacity - k}
        rest = sum(n * c for n, c in counts.items() if k <= n and 2 * n <= capacity)
        free = sum(c * (capacity - n) for n, c in half.items())
        best = max(best, alone + sum(half.values()) + max(0, -(-(rest - free) // capacity)))
    return best


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_everything_in_few_bins(seed):
    rng = random.Random(seed)
    counts = dict(Counter(rng.choice([rng.randrange(1, 2049), rng.randrange(1, 700), 1500]) for _ in range(3000)))
    used, placed = Counter(), Counter()
    for length, rank, first, bins, copies, offset in packing.plan(counts, 2048):
        assert rank == placed[length]
        placed[length] += bins * copies
        for b in range(first, first + bins):
            assert used[b] == offset
            used[b] += copies * length
    assert placed == counts and max(used.values()) <= 2048
    assert len(used) <= fewest_bins(counts, 2048) * 1.01 + 1


def test_token_counts(spark, docs):
    tokenizer = Tokenizer.from_file(BYTE_BPE)
    got = defaultdict(list)
    for r in token_counts.count_tokens(docs.dropDuplicates(["doc_id"]), BYTE_BPE).orderBy("doc_id", "section").collect():
        got[r["doc_id"]].append((r["start"], r["end"], r["n_tokens"]))
    for i, t in plain_documents():
        t = t or ""
        lines = t.splitlines(keepends=True) if "\n" in t and "\r" not in t and "\x1c" not in t else [t]
        if "".join(lines) != t or any("\x85" in x for x in lines):
            continue
        offsets = [] if not t else tokenizer.encode(t, add_special_tokens=False).offsets
        at, expected = 0, []
        for line in lines or [""]:
            expected.append((at, at + len(line), None))
            at += len(line)
        assert [x[:2] for x in got[i]] == [x[:2] for x in expected]
        assert sum(x[2] for x in got[i]) == len(offsets)
    given = spark.createDataFrame([(1, "head: body text", [("h", 0, 5), ("b", 6, 15)])], "doc_id long, text string, s array<struct<name:string,start:bigint,end:bigint>>")
    named = {r["name"]: r["n_tokens"] for r in token_counts.count_tokens(given, BYTE_BPE, sections="s").collect()}
    assert sum(named.values()) == len(tokenizer.encode("head: body text").ids) and set(named) <= {"h", "b", "(rest)"}


@pytest.mark.parametrize("kind", ["lines", "given"])
def test_tokens_of_each_section(spark, kind):
    """Counts and crossing tokens of every section against the library's own ids, byte by byte."""
    tokenizer = Tokenizer.from_file(BYTE_BPE)
    width = {i: len(bpe._byte_of_char() and t) for t, i in tokenizer.get_vocab().items()}
    rng, rows = random.Random(12), []
    for i, t in plain_documents():
        t = t or ""
        spans, at = [], rng.randrange(3)
        while at < len(t) and len(spans) < 9:
            end = min(len(t), at + rng.randrange(1, 30))
            spans.append((f"s{len(spans)}", at, end))
            at = end + rng.choice([0, 0, 2])
        rows.append((i, t, spans))
    df = spark.createDataFrame(rows, "doc_id long, text string, s array<struct<name:string,start:bigint,end:bigint>>")
    got = defaultdict(list)
    for r in token_counts.count_tokens(df, BYTE_BPE, sections="s" if kind == "given" else None).collect():
        got[r["doc_id"]].append(r)
    for i, t, spans in rows:
        if "<|" in t:
            continue
        if kind == "lines":
            lines, at = re.findall("[^\n]*\n|[^\n]+$", t) or [""], 0
            spans = []
            for line in lines:
                spans.append((None, at, at + len(line)))
                at += len(line)
        of_byte = {}
        for k, (_, a, b) in enumerate(spans):
            for p in range(len(t[:a].encode()), len(t[:b].encode())):
                of_byte[p] = k
        n, crossing, at = Counter(), Counter(), 0
        for token in tokenizer.encode(t, add_special_tokens=False).ids:
            k = of_byte.get(at, "rest")
            n[k] += 1
            crossing[k] += k != "rest" and of_byte.get(at + width[token] - 1) != k
            at += width[token]
        assert at == len(t.encode())
        for r in got[i]:
            k = "rest" if r["name"] == "(rest)" else r["section"]
            assert (r["n_tokens"], r["n_crossing"]) == (n[k], crossing[k] if k != "rest" else 0), (i, k)
        assert sum(r["n_tokens"] for r in got[i]) == sum(n.values())


def test_missing_sections(spark):
    kind = "doc_id long, text string, s array<struct<name:string,start:bigint,end:bigint>>, n_tokens int"
    rows = [(1, "some words here", [None, ("a", 0, 5), ("b", None, 9)], 1), (2, "two\nlines", None, 1), (3, "none left", [None], 1), (4, "", [], 1), (5, None, None, 1)]
    got = defaultdict(dict)
    for r in token_counts.count_tokens(spark.createDataFrame(rows, kind), BYTE_BPE, sections="s").collect():
        got[r["doc_id"]][r["name"] or r["section"]] = r["n_tokens"]
    assert set(got[1]) == {"a", "(rest)"} and set(got[2]) == {0, 1} and got[3]["(rest)"] > 0 and sum(got[4].values()) == sum(got[5].values()) == 0


def test_attribution_gives_a_token_to_its_first_byte():
    n, crossing = token_counts.attribute(np.array([3, 3, 2]), np.array([0, 4]), np.array([4, 8]))
    assert n.tolist() == [2, 1, 0] and crossing.tolist() == [1, 0, 0]


def test_vectors(spark):
    rng = np.random.default_rng(4)
    rows = []
    for c in range(12):
        centre = rng.normal(size=16)
        for _ in range(25):
            rows.append((len(rows), (centre + rng.normal(size=16) * 0.04).astype(np.float32).tolist(), c % 3))
    rows += [(1000, rows[0][1], 0), (1001, [2 * x for x in rows[0][1]], 0), (1002, None, 0), (1003, [0.0] * 16, 0), (1004, [float("nan")] * 16, 0), (1005, rows[0][1], None), (1006, [1.0, None] * 8, 1), (1007, [1.0, 2.0], 0), (1008, [2.0, 4.0], 0), (1009, [], 0)]
    df = spark.createDataFrame([(i, v, k, i) for i, v, k in rows], "vec_id long, embedding array<float>, label int, rep long")
    df = df.unionByName(df.where("vec_id = 7"))
    links, label = Counter(), {i: i for i, _, _ in rows}
    usable = [(i, np.array(v, np.float64), k) for i, v, k in rows if v and k is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    pairs = [(a, b) for n, (a, x, k) in enumerate(usable) for b, y, m in usable[n + 1 :] if k == m and len(x) == len(y) and x @ y >= 0.98 * np.sqrt((x @ x) * (y @ y))]
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    for _ in range(30):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    for block in (2048, 8):
        for r in vector_dedup.near_duplicates(df, 0.98, block=block).collect():
            assert (r["n_links"], r["component_id"]) == (links[r["vec_id"]], label[r["vec_id"]]), r["vec_id"]
    assert vector_dedup.near_duplicates(df.where("false")).count() == 0


def test_links_of_ten_thousand_vectors(spark):
    """Lists on two levels, default reach: links and components are those of brute force, also for a second length."""
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(400, 64))
    x = np.concatenate([centres[rng.integers(0, 400, 7000)] + rng.normal(size=(7000, 64)) * rng.choice([0.1, 0.14, 0.2, 0.5], (7000, 1)), rng.normal(size=(3000, 64))]).astype(np.float32)
    label = rng.integers(0, 3, len(x))
    short = (centres[rng.integers(0, 40, 200), :24] + rng.normal(size=(200, 24)) * 0.1).astype(np.float32)
    rows = [(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, label, strict=True))] + [(20_000 + i, v.tolist(), 0) for i, v in enumerate(short)]
    links, group = Counter(), {i: i for i, _, _ in rows}
    edges = []
    for ids, part, k in ((np.arange(len(x)), x, label), (20_000 + np.arange(200), short, np.zeros(200))):
        unit = part.astype(np.float64)
        unit /= np.sqrt((unit * unit).sum(1))[:, None]
        for at in range(0, len(unit), 1000):
            i, j = np.nonzero((unit[at : at + 1000] @ unit.T >= 0.98) & (k[at : at + 1000, None] == k))
            edges += [(int(ids[a + at]), int(ids[b])) for a, b in zip(i, j, strict=True) if a + at != b]
    for a, _ in edges:
        links[a] += 1
    for _ in range(20):
        for a, b in edges:
            group[a] = group[b] = min(group[a], group[b])
    assert len(edges) > 5000
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vector_dedup.near_duplicates(df, 0.98, list_rows=128).collect()}
    assert got == {i: (links[i], group[i]) for i, _, _ in rows}


def test_vector_tasks_are_bounded(spark, monkeypatch):
    """200 near vectors of one list: no task gets more than some blocks' rows."""
    real = vector_dedup._linker

    def bounded(*args):
        link = real(*args)

        def run(cell):
            assert len(cell) <= 64, len(cell)
            return link(cell)

        return run

    monkeypatch.setattr(vector_dedup, "_linker", bounded)
    rng = np.random.default_rng(6)
    centre = rng.normal(size=16)
    rows = [(i, (centre + rng.normal(size=16) * 0.01).astype(np.float32).tolist(), 0) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert {(r["n_links"], r["component_id"]) for r in vector_dedup.near_duplicates(df, 0.98, block=8).collect()} == {(199, 0)}


def test_classifier(spark):
    rng = random.Random(2)
    good = lambda: " ".join(rng.choice(["river", "stone", "walks", "slowly", "under", "the", "tall"]) + rng.choice(["", "s", "."]) for _ in range(60))
    bad = lambda: " ".join(rng.choice(["BUY", "NOW", "$$$", "###", "!!!", "CHEAP"]) for _ in range(60))
    rows = [(i, good() if i % 5 else bad(), 1 if i % 5 else 0) for i in range(900)] + [(900, None, None), (901, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = quality_classifier.fit(df, df.select("doc_id", "quality"))
    assert 0.6 < model.prior < 0.95
    scored = {r["doc_id"]: r["score"] for r in quality_classifier.score(df, model).collect()}
    held = {r["doc_id"] for r in df.where(quality_classifier.is_held_out(F.col("doc_id"))).collect()}
    assert held == {i for i in scored if zlib.crc32(str(i).encode()) % 4 == 2}
    right = [(scored[i] >= 0.7) == bool(q) for i, _, q in rows if i in held and q is not None]
    assert np.mean(right) > 0.97 and all(0 <= s <= 1 for s in scored.values())
    assert quality_classifier.score(df, None).first()["score"] == 0.5
    assert quality_classifier.fit(df.where("false"), df.select("doc_id", "quality").where("false")) is None
    assert quality_classifier.score(df, model, keep=True).columns == [*df.columns, "quality_score"]


def test_risk_slopes_are_finite_differences():
    rng = np.random.default_rng(3)
    for prior, shift in ((0.4, 0.0), (0.9, 3.0), (0.9, -3.0)):
        p, u = rng.normal(shift, 1, 7), rng.normal(0, 1, 9)
        both, (good, rest) = np.concatenate([p, u]), quality_classifier.risk(p, u, prior)
        value = lambda g: (lambda r: r[0] + r[1] if rest >= 0 else -r[1])(quality_classifier.risk(g[:7], g[7:], prior))  # noqa: B023, E731
        slopes = quality_classifier.risk_slopes(p, u, prior)
        for k in range(16):
            step = np.zeros(16)
            step[k] = 1e-5
            assert abs((value(both + step) - value(both - step)) / 2e-5 - slopes[k]) < 1e-7
    loss = lambda g: np.logaddexp(0, -g[:7]).mean() + np.logaddexp(0, g[7:]).mean()
    step = np.zeros(16)
    step[3] = 1e-5
    assert abs((loss(both + step) - loss(both - step)) / 2e-5 - quality_classifier.slopes(p, u)[3]) < 1e-7


def test_classifier_sample_is_bounded(spark, monkeypatch):
    """Rows repeating one id, with one text or ever new ones, neither overflow the sample nor starve it."""
    sizes = []
    monkeypatch.setattr(quality_classifier, "train", lambda p, u: sizes.append((len(p), len(u))))
    rows = spark.range(3000).selectExpr("if(id < 1000, 0, if(id < 2000, 1, id)) AS doc_id", "if(id < 1000, 'same text', concat('text ', id)) AS text", "1 AS quality", "'x' AS key")
    quality_classifier.fit(rows, rows.select("doc_id", "quality"), sample_rows=100)
    assert sizes[0][0] <= 150 and 60 <= sizes[0][1] <= 280


def test_licenses(spark, docs):
    rows = spark.createDataFrame([(1, "text\nReleased under the MIT license!\nmore", 0.1), (2, "Licensed under CC BY 4.0", 0.2), (3, None, 0.3), (4, "the license is under review here", 0.4)], "doc_id long, text string, dice double")
    found = {(r["doc_id"], r["unit"], r["license"], r["dice"]) for r in license_scan.scan(rows).collect()}
    near = {(1, unit, "MIT/notice", 0.8) for unit in ("paragraph", "text")}  # 4 of 6 bigrams against 4
    near |= {(1, "passage", "MIT/notice", 1.0), (2, "passage", "CC-BY-4.0/notice", 1.0)}
    assert found == near | {(1, "line", "MIT/notice", 1.0), (2, "line", "CC-BY-4.0/notice", 1.0), (2, "paragraph", "CC-BY-4.0/notice", 1.0), (2, "text", "CC-BY-4.0/notice", 1.0)}
    assert license_scan.scan(empty(spark)).count() == 0
    sets = license_scan.template_bigrams(license_scan.TEMPLATES)
    rng = random.Random(1)
    for bigrams in sets.values():  # whatever 2/3 of a template is kept, enough telling bigrams are among it
        for _ in range(20):
            kept = set(rng.sample(bigrams, -(-len(bigrams) * 2 // 3)))
            assert len(set(license_scan.telling(bigrams)) & kept) >= license_scan.least_shared(bigrams, 0.8)


def test_headers_inside_of_files_are_found(spark):
    """Wrapped and commented headers of several paragraphs right before code, and whole texts within longer ones."""
    wrap = lambda t, lead: "\n".join(lead + " ".join(w) for w in (t.split()[k : k + 11] for k in range(0, len(t.split()), 11)))
    code = "\n".join(f"def step_{k}(value): return value * {k} + offset[{k}]" for k in range(60))
    templates = license_scan.TEMPLATES
    apache, gpl, bsd = templates["Apache-2.0/header"], templates["GPL-3.0/header"], templates["BSD-3-Clause/text"]
    cut_at = gpl.index("This program is distributed")
    rows = [
        (1, wrap(apache, "# ") + "\n" + code),
        (2, "/*\n" + wrap(gpl[:cut_at], " * ") + "\n *\n" + wrap(gpl[cut_at:], " * ") + "\n */\n" + code),
        (3, code + "\n" + "\n".join("// " + x for x in bsd.split("\n")) + "\n" + code),
        (4, "Copyright (c) 2020 A. Writer\n\n" + templates["MIT/text"] + code),
        (5, code + templates["GPL-3.0/text"] + code),
        (6, code),
        (7, " ".join(w for k, w in enumerate(apache.split()) if k % 2)),
        (8, templates["Apache-2.0/text"].replace("Contribution", "Submission")),
    ]
    found = defaultdict(dict)
    for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        if r["unit"] == "passage":
            found[r["doc_id"]][r["license"]] = r["dice"]
    assert found[1] == {"Apache-2.0/header": 1.0} and found[2] == {"GPL-3.0/header": 1.0} and set(found[3]) == {"BSD-3-Clause/text"}
    assert set(found[4]) == {"MIT/text"} and found[4]["MIT/text"] > 0.98 and "GPL-3.0/text" in found[5] and 6 not in found and 7 not in found
    assert set(found[8]) == {"Apache-2.0/text"}
