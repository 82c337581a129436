"""Conversation structure repair: least-cost edits by dynamic programming over grammar-compressed role and fault sequences.

A row of a conversation is one of nine symbols: its role's initial (s, u, a, other)
with or without a cut-off end, or a row that must go (blank, or a repeated role and
text). A repaired conversation has the initials ``(s?(ua)+)?``, which an automaton of
four states reads. So a row is a 4 x 4 matrix over (min, +): what it costs to come
from one state to another by inserting turns before it and keeping, re-roling or
deleting it. A sequence is the product of its rows' matrices.

*Grammar.* The distinct sequences of a batch of conversations are compressed together
by Re-Pair (the most frequent pair becomes a rule, again and again). One product per
rule, from the bottom up, serves every conversation that holds the rule.

*Audit.* The edits' initials (D, I, K, R) of the cheapest way; the least of equally
cheap ones in ASCII order. From a given state, edits lead to one state only, and of
two different edit strings of a row sequence neither begins the other (both end with
a row's edit). So strings to different end states are ordered once and for all at
their first difference, and a product needs ranks only: an entry is a rope, the state
in between, and strings are spelt out for the chosen entries alone.

*Long conversations.* Equal rows are summed before the shuffle. Rows are then range
partitioned by conversation, turn, role and text, so a conversation of any length
spans neighbouring partitions; each is read as a stream, and a conversation that
leaves its partition or exceeds a block becomes blocks with one matrix each. The
matrices of its blocks are chained, and every block then spells its own edits.

Defined results: a null role or text is one space; a null conversation is a
conversation, null turns come first. Rows of one turn are ordered by role, then
text, so the order of input rows never matters. An empty table gives an empty one;
a conversation whose rows are all left out (``copies`` = 0) has zeros and an empty
audit. Other columns of the input stay out, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import cut

BLANKS = " \t\n\x0b\x0c\r"
#: Costs of the edits; a cut-off row that stays costs ``TRUNCATED`` more.
INSERT, REROLE, DELETE, TRUNCATED = 3, 3, 4, 3
#: Initials of neighbours that are in order.
ORDERED = ("su", "ua", "au")
START, SYSTEM, USER, ASSISTANT = range(4)
#: State after an output role of each initial, by state; -1: not allowed.
STEP = {"s": (SYSTEM, -1, -1, -1), "u": (USER, USER, -1, USER), "a": (-1, -1, ASSISTANT, -1)}
ROLE_FROM = ("user", "user", "assistant", "user")  # the role that a state asks for next
CLASSES = "sua"
GONE = 8  # the symbol of a row that must be deleted
TERMINALS = 9
FAR = 1 << 40

OK, BLANK, REPEATED, CUT_OFF = range(4)


class Matrices(NamedTuple):
    """Per sequence: least cost from state to state, the order of the strings that leave one state, the state between the halves."""

    cost: np.ndarray
    rank: np.ndarray
    middle: np.ndarray


def _inserts(state: int) -> Iterator[tuple[int, str]]:
    """States that inserted turns lead to, with the edits."""
    edits = ""
    while True:
        yield state, edits
        if len(edits) == 2:
            return
        state, edits = STEP[ROLE_FROM[state][0]][state], edits + "I"


def _row(symbol: int) -> dict[tuple[int, int], tuple[int, str]]:
    """(from, to) -> (cost, edits) of one row with the inserts before it."""
    kind, late = (None, 0) if symbol == GONE else ("sua?"[symbol % 4], TRUNCATED * (symbol // 4))
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for start in range(4):
        for state, edits in _inserts(start):
            paid = INSERT * len(edits)
            ways = [(state, paid + DELETE, edits + "D")]
            if symbol != GONE:
                ways.append((STEP[ROLE_FROM[state][0]][state], paid + REROLE + late, edits + "R"))
                if kind in STEP:
                    ways.append((STEP[kind][state], paid + late, edits + "K"))
            for end, cost, spelt in ways:
                if end >= 0 and (cost, spelt) < best.get((start, end), (FAR, "")):
                    best[start, end] = (cost, spelt)
    return best


ROWS = [_row(s) for s in range(TERMINALS)]


def _ranks(keys: np.ndarray) -> np.ndarray:
    return np.argsort(np.argsort(keys, axis=-1, kind="stable"), axis=-1, kind="stable").astype(np.int64)


def terminal_matrices() -> Matrices:
    """The nine symbols' matrices."""
    cost = np.full((TERMINALS, 4, 4), FAR, np.int64)
    rank = np.zeros((TERMINALS, 4, 4), np.int64)
    for s, ways in enumerate(ROWS):
        for (p, q), (c, _) in ways.items():
            cost[s, p, q] = c
        for p in range(4):
            order = sorted(range(4), key=lambda q: ways[p, q][1] if (p, q) in ways else "~")  # noqa: B023
            for place, q in enumerate(order):
                rank[s, p, q] = place
    return Matrices(cost, rank, np.full((TERMINALS, 4, 4), -1, np.int64))


def multiply(a: Matrices, b: Matrices) -> Matrices:
    """Products over (min, +) of arrays of matrices; ties go to the string of lower rank."""
    total = np.minimum(a.cost[:, :, :, None] + b.cost[:, None, :, :], FAR)
    middle = np.argmin(total * 4 + a.rank[:, :, :, None], axis=2)
    cost = np.take_along_axis(total, middle[:, :, None, :], axis=2)[:, :, 0, :]
    first = np.take_along_axis(a.rank, middle, axis=2)
    second = np.take_along_axis(b.rank, middle, axis=1)
    return Matrices(cost, _ranks(first * 4 + second + (cost >= FAR) * 64), middle)


def grammar(sequences: list[np.ndarray], least: int = 8, most: int = 1000) -> tuple[list[tuple[int, int]], list[np.ndarray]]:
    """Re-Pair over all sequences together: rules (pairs of symbols, numbered from ``TERMINALS``) and what is left of each sequence.

    Pairs that occur fewer than ``least`` times stay, since a rule would not pay.
    """
    ends = np.cumsum([len(s) + 1 for s in sequences])
    text = np.concatenate([x for s in sequences for x in (s, [-1])]).astype(np.int64) if sequences else np.zeros(0, np.int64)
    rules: list[tuple[int, int]] = []
    owner = np.repeat(np.arange(len(sequences)), np.diff(ends, prepend=0))
    while len(text) > 1 and len(rules) < most:
        size = TERMINALS + len(rules)
        pairs = np.where((text[:-1] >= 0) & (text[1:] >= 0), text[:-1] * size + text[1:], size * size)
        counts = np.bincount(pairs, minlength=size * size + 1)[:-1]
        best = int(counts.argmax())
        if counts[best] < least:
            break
        left, right = divmod(best, size)
        hits = np.flatnonzero(pairs == best)
        if left == right:  # of overlapping places every other one, from the left
            fresh = np.concatenate(([True], np.diff(hits) > 1))
            run_start = np.maximum.accumulate(np.where(fresh, np.arange(len(hits)), 0))
            hits = hits[(np.arange(len(hits)) - run_start) % 2 == 0]
        rules.append((left, right))
        text[hits] = size
        keep = np.ones(len(text), bool)
        keep[hits + 1] = False
        text, owner = text[keep], owner[keep]
    cuts = np.searchsorted(owner, np.arange(len(sequences) + 1))
    return rules, [text[a : b - 1] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def rule_matrices(rules: list[tuple[int, int]]) -> Matrices:
    """Matrices of all symbols, rules from the bottom up."""
    base = terminal_matrices()
    n = TERMINALS + len(rules)
    out = Matrices(*(np.concatenate([x, np.zeros((len(rules), 4, 4), np.int64)]) for x in base))
    done = TERMINALS
    while done < n:  # all rules whose parts are done, together
        ready = done
        while ready < n and max(rules[ready - TERMINALS]) < done:
            ready += 1
        left, right = np.array(rules[done - TERMINALS : ready - TERMINALS]).T
        made = multiply(Matrices(*(x[left] for x in out)), Matrices(*(x[right] for x in out)))
        for whole, part in zip(out, made, strict=True):
            whole[done:ready] = part
        done = ready
    return out


class Compressed:
    """Sequences of symbols under one grammar, with the matrix of each."""

    def __init__(self, sequences: list[bytes], least: int = 8) -> None:
        self.distinct = {s: i for i, s in enumerate(dict.fromkeys(sequences))}
        self.rules, self.left = grammar([np.frombuffer(s, np.uint8) for s in self.distinct], least)
        self.symbols = rule_matrices(self.rules)
        self.steps: list[np.ndarray] = []  # the state before each symbol but the first, for every (from, to)
        n = len(self.left)
        lengths = np.array([len(x) for x in self.left], np.int64)
        total = [np.full((n, 4, 4), FAR, np.int64), np.zeros((n, 4, 4), np.int64)]
        order = np.argsort(-lengths, kind="stable")
        self.place = np.empty(n, np.int64)
        self.place[order] = np.arange(n)
        for t in range(int(lengths.max(initial=0))):
            live = order[: int((lengths > t).sum())]
            now = Matrices(*(x[[self.left[i][t] for i in live]] for x in self.symbols))
            if t:
                now = multiply(Matrices(total[0][live], total[1][live], total[1][live]), now)
                self.steps.append(now.middle.astype(np.int8))
            total[0][live], total[1][live] = now.cost, now.rank
        self.cost, self.rank = total

    def spell(self, wanted: list[tuple[bytes, int, int]]) -> list[str]:
        """The edits of sequences from one state to another."""
        paths = []
        needed: set[tuple[int, int, int]] = set()
        for sequence, start, end in wanted:
            i = self.distinct[sequence]
            path, to = [], end
            for t in range(len(self.left[i]) - 1, -1, -1):
                come = int(self.steps[t - 1][self.place[i], start, to]) if t else start
                path.append((int(self.left[i][t]), come, to))
                to = come
            paths.append(path[::-1])
            needed.update(path)
        spelt: dict[tuple[int, int, int], str] = {}
        levels: dict[int, set[tuple[int, int, int]]] = {}
        for entry in needed:
            levels.setdefault(entry[0], set()).add(entry)
        for symbol in range(TERMINALS + len(self.rules) - 1, TERMINALS - 1, -1):  # ropes are followed down,
            a, b = self.rules[symbol - TERMINALS]
            for _, p, q in levels.get(symbol, ()):
                r = int(self.symbols.middle[symbol, p, q])
                levels.setdefault(a, set()).add((a, p, r))
                levels.setdefault(b, set()).add((b, r, q))
        for symbol in range(TERMINALS + len(self.rules)):  # and spelt up, each entry once
            for _, p, q in levels.get(symbol, ()):
                if symbol < TERMINALS:
                    spelt[symbol, p, q] = ROWS[symbol][p, q][1]
                else:
                    a, b = self.rules[symbol - TERMINALS]
                    r = int(self.symbols.middle[symbol, p, q])
                    spelt[symbol, p, q] = spelt[a, p, r] + spelt[b, r, q]
        return ["".join([spelt[x] for x in path]) for path in paths]


#: What may still be inserted at the end: (state, cost, edits).
ENDINGS = [(START, 0, ""), (ASSISTANT, 0, ""), (USER, INSERT, "I"), (SYSTEM, 2 * INSERT, "II")]


def ending(cost: np.ndarray, rank: np.ndarray) -> tuple[int, int, str]:
    """Least cost, the state before the last inserts and these, for the costs and ranks of the states reached from the start."""
    total, _, state, edits = min((int(cost[s]) + c, int(rank[s]), s, e) for s, c, e in ENDINGS)
    return total, state, edits


def replay(audit: str, rows: Iterator[tuple[str, str]], state: int = START) -> Iterator[tuple[str, str]]:
    """Role and text of the repaired turns: the edits applied to the rows, from a state on."""
    for edit in audit:
        if edit == "I":
            role, text = ROLE_FROM[state], ""
        else:
            role, text = next(rows)
            if edit == "D":
                continue
            if edit == "R":
                role = ROLE_FROM[state]
        state = STEP[role[0]][state]
        yield role, text


class _Block:
    """Rows of one conversation, in order, with their summary."""

    def __init__(self, conv: object) -> None:
        self.conv = conv
        self.symbols = bytearray()
        self.rows: list[tuple[str, str, int]] = []  # role, text, symbol; equal rows that follow are rows
        self.counts = [0, 0, 0, 0]  # by fault
        self.illegal = self.turns = self.size = 0
        self.low = self.high = None
        self.first = self.last = None  # (turn, initial)

    def add(self, turn: int | None, role: str, text: str, fault: int) -> None:
        initial = role[:1]
        late = 4 if fault == CUT_OFF else 0
        symbol = GONE if fault in (BLANK, REPEATED) else late + (CLASSES.find(initial) if initial and initial in CLASSES else 3)
        self.symbols.append(symbol)
        self.rows.append((role, text, symbol))
        self.size += len(text) + len(role) + 16
        self.counts[fault] += 1
        if self.last is None:
            self.first = (turn, initial)
        elif self.last[1] + initial not in ORDERED:
            self.illegal += 1
        if turn is not None:
            self.turns += self.last is None or self.last[0] != turn
            self.low = turn if self.low is None else self.low
            self.high = turn
        self.last = (turn, initial)


def _gaps(low: int | None, high: int | None, turns: int) -> int:
    return 0 if low is None else high - low + 1 - turns


_SUMMARY = "conv_id {kind}, part int, seq int, whole boolean, blank long, duplicate long, truncated long, illegal long, low long, high long, turns long, first_turn long, first_initial string, last_turn long, last_initial string"
_RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def prepare(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", copies: str | None = None) -> DataFrame:
    """``conv_id, turn, role, text, copies, fault``: equal rows summed, each with the fault of its first copy.

    ``copies`` names a column with the number of times that a row counts; a row that
    counts zero times leaves its conversation's id only.
    """
    n = F.col(copies).cast("long") if copies else F.lit(1).cast("long")
    here = n > 0
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select(
        F.col(conv_id).alias("conv_id"),
        F.when(here, F.col(turn).cast("long")).alias("turn"),
        F.when(here, space(role)).otherwise("").alias("role"),
        F.when(here, space(text)).otherwise("").alias("text"),
        n.alias("copies"),
    )
    kept = F.rtrim("text", F.lit(BLANKS))
    summed = cut(
        rows.groupBy("conv_id", "turn", "role", "text")
        .agg(F.sum("copies").alias("copies"))
        .withColumns({"blank": kept == "", "cut_off": ~F.right(kept, F.lit(1)).isin(".", "!", "?"), "key": F.unhex(F.sha2("text", 256))})
    )
    # Role and text in several turns: all but the first are repeats. Null turns come first, and min() over structs puts them there.
    first = (
        summed.where((F.col("copies") > 0) & ~F.col("blank"))
        .groupBy("conv_id", "role", "key")
        .agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("key").alias("k"), F.struct(F.col("first.turn")).alias("first"))
    )
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("key") == F.col("k"))
    again = F.col("k").isNotNull() & ~F.struct("turn").eqNullSafe(F.col("first"))
    fault = F.when(F.col("blank"), BLANK).when(again, REPEATED).when(F.col("cut_off"), CUT_OFF).otherwise(OK)
    return summed.join(first, same, "left").select("conv_id", "turn", "role", "text", "copies", fault.alias("fault"))


def _blocks(batches: Iterator[pa.RecordBatch], block_rows: int, block_bytes: int) -> Iterator[tuple[_Block, bool]]:
    """Blocks of a sorted stream, each with whether it is a whole conversation as far as this partition can tell."""
    block, fresh, opened = None, True, True  # fresh: no earlier block of the conversation; opened: it may have begun in the partition before
    for batch in batches:
        for conv, turn, role, text, copies, fault in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            if block is None or block.conv != conv:
                if block is not None:
                    yield block, fresh and not opened
                    opened = False
                block, fresh = _Block(conv), True
            for copy in range(copies):
                if len(block.rows) >= block_rows or block.size >= block_bytes:
                    yield block, False
                    block, fresh = _Block(conv), False
                block.add(turn, role, text, fault if copy == 0 or fault == BLANK else REPEATED)
    if block is not None:
        yield block, False  # it may go on in the next partition


def _lines(turns: Iterator[tuple[str, str]]) -> str:
    return "\n".join([f"{role}:{text}" for role, text in turns])


def repair(
    turns: DataFrame,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    copies: str | None = None,
    digest: bool = False,
    block_rows: int = 8192,
    block_bytes: int = 4 << 20,
) -> DataFrame:
    """One row per conversation: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit`` and the repair.

    The repair is ``repaired``, an array of ``role, text``, or with ``digest`` the
    column ``repaired_sha256`` over its ``role:text`` lines, for which no conversation
    is ever whole in memory.
    """
    rows = prepare(turns, conv_id, turn, role, text, copies)
    kind = rows.schema["conv_id"].dataType.simpleString()
    row_type = "struct<role:string,text:string,symbol:int>"
    own = "repaired_sha256 string" if digest else "repaired array<struct<role:string,text:string>>"
    out = f"{_SUMMARY.format(kind=kind)}, cost array<long>, rank array<long>, rows array<{row_type}>, least long, audit string, {own}"
    names = [x.split()[0] for x in out.split(", ")]

    def emit(blocks: list[tuple[int, _Block, bool]], part: int, types: pa.Schema) -> pa.RecordBatch:
        packed = Compressed([bytes(b.symbols) for _, b, _ in blocks])
        ends = [ending(packed.cost[i, START], packed.rank[i, START]) if len(b.symbols) else (0, START, "") for _, b, _ in blocks for i in [packed.distinct[bytes(b.symbols)]]]
        closed = [k for k, (_, _, whole) in enumerate(blocks) if whole]
        audits = dict(zip(closed, packed.spell([(bytes(blocks[k][1].symbols), START, ends[k][1]) for k in closed]), strict=True))
        table: list[tuple] = []
        for k, (seq, b, whole) in enumerate(blocks):
            i = packed.distinct[bytes(b.symbols)]
            (t0, i0), (t1, i1) = b.first or (None, None), b.last or (None, None)
            summary = (b.conv, part, seq, whole, b.counts[BLANK], b.counts[REPEATED], b.counts[CUT_OFF], b.illegal, b.low, b.high, b.turns, t0, i0, t1, i1)
            if whole:
                audit = audits[k] + ends[k][2]
                made = replay(audit, ((r, t) for r, t, _ in b.rows))
                repaired = hashlib.sha256(_lines(made).encode()).hexdigest() if digest else [{"role": r, "text": t} for r, t in made]
                table.append((*summary, None, None, None, ends[k][0], audit, repaired))
            else:
                kept = [{"role": r, "text": t, "symbol": s} for r, t, s in b.rows]
                table.append((*summary, packed.cost[i].ravel().tolist(), packed.rank[i].ravel().tolist(), kept, None, None, None))
        return pa.RecordBatch.from_arrays([pa.array(c, types.field(i).type) for i, c in enumerate(zip(*table, strict=True))], names)

    pair = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
    triple = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string()), ("symbol", pa.int32())]))

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: list[tuple[int, _Block, bool]] = []
        rows_held = bytes_held = 0
        id_type: list[pa.DataType] = []

        def seen(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in stream:
                id_type[:] = [batch.schema.field(0).type]
                yield batch

        def schema() -> pa.Schema:
            whole = [id_type[0], pa.int32(), pa.int32(), pa.bool_(), *[pa.int64()] * 7, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), triple, pa.int64(), pa.string(), pa.string() if digest else pair]
            return pa.schema(list(zip(names, whole, strict=True)))

        for seq, (block, whole) in enumerate(_blocks(seen(batches), block_rows, block_bytes)):
            held.append((seq, block, whole))
            rows_held += len(block.rows) + 1
            bytes_held += block.size
            if rows_held >= 2 * block_rows or bytes_held >= 2 * block_bytes:
                yield emit(held, part, schema())
                held, rows_held, bytes_held = [], 0, 0
        if held:
            yield emit(held, part, schema())

    order = ["conv_id", "turn", "role", "text"]
    blocks = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(first_pass, out))
    results = ["conv_id", *[x.split()[0] for x in _RESULT.split(", ")], own.split()[0]]
    closed = blocks.where("whole").select(
        "conv_id", F.when(F.col("low").isNull(), 0).otherwise(F.col("high") - F.col("low") + 1 - F.col("turns")).cast("long").alias("gaps"), "blank", "duplicate", "truncated", "illegal", F.col("least").alias("cost"), "audit", own.split()[0]
    )
    opened = _open(blocks.where("NOT whole"), kind, digest)
    return closed.select(*results).unionByName(opened.select(*results))


def _open(blocks: DataFrame, kind: str, digest: bool) -> DataFrame:
    """Results of the conversations that lie in several blocks, or at a partition's edge."""
    chained = f"part int, seq int, at long, enter int, leave int, tail string, {_RESULT.replace(', audit string', '')}"

    def chain(found):  # the summaries of one conversation's blocks
        import pandas as pd

        found = found.sort_values(["part", "seq"]).to_dict("list")
        n = len(found["part"])
        whole, befores = None, []
        for cost, rank in zip(found["cost"], found["rank"], strict=True):
            cost, rank = (np.array(x, np.int64).reshape(1, 4, 4) for x in (cost, rank))
            now = Matrices(cost, rank, rank)
            if (cost >= FAR).all():  # no rows: it changes nothing
                befores.append(None)
                continue
            if whole is None:
                befores.append(np.zeros((4, 4), np.int64) + np.arange(4)[:, None])
            else:
                now = multiply(whole, now)
                befores.append(now.middle[0])
            whole = now
        least, state, tail = (0, START, "") if whole is None else ending(whole.cost[0, START], whole.rank[0, START])
        enter, leave = [START] * n, [START] * n
        for k in range(n - 1, -1, -1):
            leave[k] = state
            if befores[k] is not None:
                state = int(befores[k][START, state])
            enter[k] = state
        illegal, turns, low, high, last = sum(found["illegal"]), sum(found["turns"]), None, None, None
        for k in range(n):
            if befores[k] is None:
                continue
            if last is not None:
                illegal += found["last_initial"][last] + found["first_initial"][k] not in ORDERED
                a, b = found["last_turn"][last], found["first_turn"][k]
                turns -= not pd.isna(a) and not pd.isna(b) and a == b
            if not pd.isna(found["low"][k]):
                low = found["low"][k] if low is None else low
                high = found["high"][k]
            last = k
        gaps = _gaps(low, high, turns)
        sums = [sum(found[c]) for c in ("blank", "duplicate", "truncated")]
        rows = [(found["part"][k], found["seq"][k], k, enter[k], leave[k], tail if k == n - 1 else "", int(gaps), *sums, int(illegal), least) for k in range(n)]
        return pd.DataFrame(rows, columns=[x.split()[0] for x in chained.split(", ")])

    summary = blocks.drop("whole", "rows", "least", "audit", "repaired", "repaired_sha256")
    places = cut(summary.groupBy("conv_id").applyInPandas(chain, chained))
    named = blocks.select("conv_id", F.col("part").alias("p"), F.col("seq").alias("s"), "rows")
    dealt = named.join(places, (F.col("p") == F.col("part")) & (F.col("s") == F.col("seq"))).drop("p", "s")
    pieces_type = f"conv_id {kind}, at long, {_RESULT.replace('audit string', 'piece string')}, made {'binary' if digest else 'array<struct<role:string,text:string>>'}"
    fixed = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(batch.num_rows):
                one = batch.slice(start, 1)
                row = one.select(["rows", "enter", "leave", "tail"]).to_pylist()[0]
                symbols = bytes(r["symbol"] for r in row["rows"])
                audit = (Compressed([symbols]).spell([(symbols, row["enter"], row["leave"])])[0] if symbols else "") + row["tail"]
                made = list(replay(audit, ((r["role"], r["text"]) for r in row["rows"]), row["enter"]))
                if digest:
                    last = pa.array([_lines(made).encode() if made else None], pa.binary())
                else:
                    last = pa.array([[{"role": r, "text": t} for r, t in made]], pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))
                columns = [one.column(c) for c in ("conv_id", "at", *fixed)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([audit]), last], ["conv_id", "at", *fixed, "piece", "made"])

    pieces = dealt.mapInArrow(spell, pieces_type)
    if not digest:
        held = pieces.groupBy("conv_id").agg(*[F.first(c).alias(c) for c in fixed], F.sort_array(F.collect_list(F.struct("at", "piece", "made"))).alias("all"))
        return held.select("conv_id", *fixed, F.array_join("all.piece", "").alias("audit"), F.flatten("all.made").alias("repaired"))
    result = f"conv_id {kind}, {_RESULT}, repaired_sha256 string"

    def hash_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, names = None, [x.split()[0] for x in result.split(", ")]

        def row(held: tuple) -> pa.RecordBatch:
            first, audit, sha, _ = held
            ends = [first.column(c) for c in ("conv_id", *fixed)]
            return pa.RecordBatch.from_arrays([*ends, pa.array(["".join(audit)]), pa.array([sha.hexdigest()])], names)

        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                conv, piece, made = (one.column(c)[0].as_py() for c in ("conv_id", "piece", "made"))
                if current is None or conv != current[0].column("conv_id")[0].as_py():
                    if current is not None:
                        yield row(current)
                    current = [one, [], hashlib.sha256(), False]
                current[1].append(piece)
                if made is not None:
                    current[2].update((b"\n" if current[3] else b"") + made)
                    current[3] = True
        if current is not None:
            yield row(current)

    return pieces.repartition("conv_id").sortWithinPartitions("conv_id", "at").mapInArrow(hash_lines, result)


def damage(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", modulus: int = 20) -> DataFrame:
    """``conv_id, turn, role, text, copies`` with faults planted by the checksum of ``conv_id:turn``: 0 drops a row, 1 empties
    its text, 2 removes its sentence ends, 3 repeats it, 4 makes it the user's. Nulls are one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    drawn: Column = F.crc32(F.concat_ws(":", space(conv_id), space(turn)).cast("binary")) % modulus
    return turns.withColumn("__drawn", drawn).select(
        F.col(conv_id).alias("conv_id"),
        F.col(turn).alias("turn"),
        F.when(F.col("__drawn") == 4, "user").otherwise(space(role)).alias("role"),
        F.when(F.col("__drawn") == 1, "").when(F.col("__drawn") == 2, F.translate(space(text), ".!?", "")).otherwise(space(text)).alias("text"),
        F.when(F.col("__drawn") == 0, 0).when(F.col("__drawn") == 3, 2).otherwise(1).alias("copies"),
    )
