"""Conversation repair against brute force: a search over whole edit strings, and plain counts."""

import hashlib
import heapq
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import conversation_repair as cr
from lodestone.llm import queries

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"
BLANK = " \t\n\x0b\x0c\r"
NEXT = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        body = text.strip(BLANK)
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append(fault)
    return out


def cheapest(rows):
    """Least (cost, edits) and the repaired turns, by Dijkstra over whole (row, last initial) states with whole strings."""
    found = faults(rows)
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, edits, at, state, turns = heapq.heappop(heap)
        if at == len(rows) and state in ("", "a"):
            return cost, edits, list(turns)
        if (at, state) in done:
            continue
        done.add((at, state))
        for role in ("user", "assistant"):
            if role[0] in NEXT[state]:
                heapq.heappush(heap, (cost + 3, edits + "I", at, role[0], (*turns, (role, ""))))
        if at == len(rows):
            continue
        role, text = rows[at]
        heapq.heappush(heap, (cost + 4, edits + "D", at + 1, state, turns))
        if found[at] in ("blank", "duplicate"):
            continue
        late = 3 * (found[at] == "truncated")
        if role[:1] in NEXT[state]:
            heapq.heappush(heap, (cost + late, edits + "K", at + 1, role[:1], (*turns, (role, text))))
        for new in ("user", "assistant"):
            if new[0] in NEXT[state]:
                heapq.heappush(heap, (cost + late + 3, edits + "R", at + 1, new[0], (*turns, (new, text))))


def every_string(symbols):
    """Least (cost, edits) over all edit strings with up to two inserts before each row and at the end."""
    best = None

    def go(at, state, cost, edits, inserts):
        nonlocal best
        if at == len(symbols) and state in ("", "a") and (best is None or (cost, edits) < best):
            best = (cost, edits)
        if inserts < 2:
            for new in "ua":
                if new in NEXT[state]:
                    go(at, new, cost + 3, edits + "I", inserts + 1)
        if at == len(symbols):
            return
        go(at + 1, state, cost + 4, edits + "D", 0)
        if symbols[at] == 8:
            return
        initial, late = "sua?"[symbols[at] % 4], 3 * (symbols[at] // 4)
        if initial in NEXT[state]:
            go(at + 1, initial, cost + late, edits + "K", 0)
        for new in "ua":
            if new in NEXT[state]:
                go(at + 1, new, cost + late + 3, edits + "R", 0)

    go(0, "", 0, "", 0)
    return best


def solved(packed, symbols):
    i = packed.distinct[symbols]
    least, state, tail = cr.ending(packed.cost[i, 0], packed.rank[i, 0]) if symbols else (0, 0, "")
    return least, packed.spell([(symbols, 0, state)])[0] + tail


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 8), max_size=5).map(bytes), min_size=1, max_size=6), st.sampled_from([1, 2, 8]))
def test_matrices_against_every_edit_string(sequences, least):
    packed = cr.Compressed(sequences, least)
    for s in sequences:
        assert solved(packed, s) == every_string(s)


def test_grammar_spells_its_sequences():
    rng = random.Random(5)
    sequences = [bytes(rng.choices(range(9), k=rng.randrange(40))) for _ in range(200)] + [bytes([8]) * 3000, bytes([1, 2]) * 700, b""]
    rules, left = cr.grammar([np.frombuffer(s, np.uint8) for s in sequences], least=4)
    whole = {}
    for k, (a, b) in enumerate(rules):
        whole[9 + k] = whole.get(a, bytes([a]) if a < 9 else b"") + whole.get(b, bytes([b]) if b < 9 else b"")
    assert [b"".join(whole.get(int(x), bytes([x]) if x < 9 else b"") for x in seq) for seq in left] == sequences
    assert len(rules) > 20 and len(left[200]) < 200


def plain(rows, n_before):
    """The contract's row for one conversation's (turn, role, text) rows, in order."""
    found = faults([(r, t) for _, r, t in rows])
    turns = {t for t, _, _ in rows if t is not None}
    cost, audit, repaired = cheapest([(r, t) for _, r, t in rows])
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:], strict=False)]
    lines = "\n".join(f"{r}:{t}" for r, t in repaired)
    return {
        "gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0,
        **{k: found.count(k) for k in ("blank", "duplicate", "truncated")},
        "illegal": sum(p not in ("su", "ua", "au") for p in pairs),
        "cost": cost,
        "audit": audit,
        "repaired_sha256": hashlib.sha256(lines.encode()).hexdigest(),
    }


def expected(rows):
    held = defaultdict(list)
    for conv, turn, role, text in rows:
        held[conv]  # noqa: B018  every original id has a row
        role, text = " " if role is None else role, " " if text is None else text
        drawn = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if drawn == 0:
            continue
        text = "" if drawn == 1 else text.translate({ord(c): None for c in ".!?"}) if drawn == 2 else text
        role = "user" if drawn == 4 else role
        held[conv] += [(turn, role, text)] * (2 if drawn == 3 else 1)
    order = lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])
    return {conv: plain(sorted(rows, key=order), len(rows)) for conv, rows in held.items()}


def hostile():
    rng = random.Random(11)
    roles = ["user", "assistant", "system", "tool", "", None, "User", "Ünser", "u", "sys"]
    said = ["Yes.", "No!", "and so", "", None, " \t", "Why?\n", "Yes.", "日本語。", "ok.\x0b"]
    rows = [(c, rng.choice([None, rng.randrange(9), rng.randrange(9)]), rng.choice(roles), rng.choice(said)) for c in range(60) for _ in range(rng.randrange(1, 12))]
    rows += [(None, i, roles[i % 2], f"turn {i}.") for i in range(7)] + [rows[5]] * 30
    rows += [(1000, i, roles[i % 2] if i % 7 else "system", f"line {i % 50}" + "." * (i % 3)) for i in range(900)]
    return rows


def check(got, rows):
    want = expected(rows)
    assert len(got) == len(want)
    for r in got:
        assert {k: r[k] for k in want[r["conv_id"]]} == want[r["conv_id"]], r["conv_id"]


@pytest.mark.parametrize("block_rows, block_bytes", [(8192, 4 << 20), (16, 4 << 20), (8192, 200)])
def test_repair_of_hostile_rows(spark, block_rows, block_bytes):
    """Null ids, turns, roles and texts, ties, repeated rows, a conversation over many partitions and blocks, clashing columns."""
    rows = hostile()
    df = spark.createDataFrame([(*r, "en", 7, "x") for r in rows], SCHEMA + ", audit string, copies long, key string").repartition(5)
    got = cr.repair(cr.damage(df), copies="copies", digest=True, block_rows=block_rows, block_bytes=block_bytes).collect()
    check(got, rows)


def test_repaired_turns_are_in_order(spark):
    rows = hostile()
    df = spark.createDataFrame(rows, SCHEMA)
    whole = {r["conv_id"]: r for r in cr.repair(cr.damage(df), copies="copies", block_rows=50).collect()}
    for r in cr.repair(cr.damage(df), copies="copies", digest=True).collect():
        made = whole[r["conv_id"]]
        lines = "\n".join(f"{x['role']}:{x['text']}" for x in made["repaired"])
        assert hashlib.sha256(lines.encode()).hexdigest() == r["repaired_sha256"] and made["audit"] == r["audit"] and made["cost"] == r["cost"]
        initials = "".join(x["role"][0] for x in made["repaired"]).removeprefix("s")
        assert initials == "ua" * (len(initials) // 2) and (initials or not made["repaired"])


def test_empty_table_and_dropped_conversation(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert cr.repair(empty, digest=True).count() == 0 and cr.repair(empty).count() == 0
    rows = spark.createDataFrame([(1, 0, "user", "Hi.", 0), (1, 1, "user", "Hi.", 0)], SCHEMA + ", n long")
    for r in [cr.repair(rows, copies="n", digest=True).collect()[0]]:
        assert (r["gaps"], r["blank"], r["cost"], r["audit"], r["repaired_sha256"]) == (0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_a_very_long_conversation_is_spread(spark):
    """60,000 rows of one id: several blocks, counts as they should be, and no Python group holds its texts."""
    rows = spark.range(60_000).selectExpr("7L AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "concat('text ', id, '.') AS text")
    r = cr.repair(rows, digest=True).collect()[0]
    assert r["audit"] == "K" * 60_000 and r["cost"] == 0 and r["gaps"] == 0
    lines = "\n".join(f"{'user' if i % 2 == 0 else 'assistant'}:text {i}." for i in range(60_000))
    assert r["repaired_sha256"] == hashlib.sha256(lines.encode()).hexdigest()


def test_query_over_the_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    check(queries.op12_conversation_repair(spark, SF).collect(), rows)
