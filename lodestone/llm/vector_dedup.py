"""Near-duplicate vectors of one label by product quantisation.

1. Equal vectors of a label fold into one row with a count.
2. A coarse quantiser of two levels (top cells, then the lists inside of each) and,
   for its residuals, one codebook a subspace are fitted on a bounded sample
   (``sample_rows`` or eight rows a list, at most 131,072, drawn by a hash of the id),
   for each vector length of the sample. Lists grow with the table, up to 16,384, so
   that a list holds some 1000 rows. Every vector is indexed: its inverted list, its
   residual codes, and the length of what the codes leave out.
3. A vector probes, besides its own list, each later list it may have a neighbour in:
   the planes that bisect the way there, between top cells and then between lists, lie
   within ``reach``. That is the search radius, so no pair is lost in whatever direction
   it lies. (A ``slack`` makes it at most ``slack`` radii over the root of the length, which
   pairs in random directions hardly ever exceed, but pairs on a curve do.) Every pair of
   lists is probed from one side only.
4. The rows of a list and those that probe it are dealt into blocks, and every task
   gets one pair of blocks, so neither side grows with a list. Asymmetric distances are sums of looked
   up parts; a pair survives if that distance is within the radius plus the
   stored vector's residual length (triangle inequality). Survivors are decided
   by exact cosine in double precision.
5. A block sends on counts of links and at most one edge a vector; components of
   the edges are the groups. Pairs never leave a task.

Defined results: null, empty or zero vectors, vectors with null or non-finite
components, and vectors with a null label link with nothing. Vectors of
different length never link. Rows repeating an id and vector count as one
vector and are each returned. Other columns of the input stay out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import components, cut

CELL = ["label", "dim", "list", "i", "j"]


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centres, less each row's own square."""
    return (centres * centres).sum(1) - 2 * (x @ centres.T)


def _k_means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = _nearest(x, centres).argmin(1)
        order = np.argsort(own, kind="stable")
        at = np.flatnonzero(np.diff(own[order], prepend=-1))
        if len(at):
            centres[own[order[at]]] = np.add.reduceat(x[order], at) / np.diff(np.append(at, len(x)))[:, None]
    return centres


def _apart(centres: np.ndarray) -> np.ndarray:
    square = (centres * centres).sum(1)
    return np.sqrt(np.maximum(square[:, None] + square - 2 * (centres @ centres.T), 0))


def _within(d: np.ndarray, best: np.ndarray, apart: np.ndarray, reach: float) -> np.ndarray:
    """Which centres lie behind a plane within ``reach``, the plane between each and the best; ``d`` as of :func:`_nearest`."""
    return d - d[np.arange(len(d)), best][:, None] <= 2 * apart[best] * reach + 1e-9


class Index:
    """Coarse centres on two levels and residual codebooks for unit vectors of one length."""

    def __init__(self, sample: np.ndarray, lists: int, parts: int = 16, codes: int = 256, seed: int = 1):
        rng = np.random.default_rng(seed)
        dim = sample.shape[1]
        self.tops = _k_means(sample, math.ceil(math.sqrt(lists)), 8, rng)
        own = _nearest(sample, self.tops).argmin(1)
        within = [sample[own == t] if (own == t).any() else self.tops[t : t + 1] for t in range(len(self.tops))]
        inner = [_k_means(x, max(1, round(lists * len(x) / len(sample))), 8, rng) for x in within]
        self.starts = np.cumsum([0, *map(len, inner)])
        self.centres = np.concatenate(inner)
        self.apart, self.inner_apart = _apart(self.tops), [_apart(c) for c in inner]
        some = sample[:20_000]
        residual = some - self.centres[self.place(some, 0.0)[0]]
        self.cuts = [dim * i // min(parts, dim) for i in range(min(parts, dim) + 1)]
        self.books = [_k_means(residual[:, a:b], codes, 6, rng) for a, b in zip(self.cuts, self.cuts[1:], strict=False)]

    def place(self, x: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List of each unit vector, and as pairs (row, list) the later lists to probe."""
        d = _nearest(x, self.tops)
        top = d.argmin(1)
        near = _within(d, top, self.apart, reach)
        own, rows, lists = np.empty(len(x), np.int64), [], []
        for t in range(len(self.tops)):
            at = np.flatnonzero(near[:, t])
            if len(at):
                inside = _nearest(x[at], self.centres[self.starts[t] : self.starts[t + 1]])
                best = inside.argmin(1)
                mine = top[at] == t
                own[at[mine]] = self.starts[t] + best[mine]
                i, j = np.nonzero(_within(inside, best, self.inner_apart[t], reach))
                rows.append(at[i])
                lists.append(self.starts[t] + j)
        rows, lists = np.concatenate(rows), np.concatenate(lists)
        later = lists > own[rows]
        return own, rows[later], lists[later]

    def encode(self, x: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        """List, codes, residual length and the later lists to probe of each unit vector."""
        own, rows, lists = self.place(x, reach)
        rest = x - self.centres[own]
        codes = np.empty((len(x), len(self.books)), np.uint8)
        for p, (a, b) in enumerate(zip(self.cuts, self.cuts[1:], strict=False)):
            codes[:, p] = _nearest(rest[:, a:b], self.books[p]).argmin(1)
            rest[:, a:b] -= self.books[p][codes[:, p]]
        order = np.argsort(rows, kind="stable")
        probes = np.split(lists[order], np.searchsorted(rows[order], np.arange(1, len(x))))
        return own, codes, np.sqrt((rest * rest).sum(1)), probes

    def distances(self, x: np.ndarray, own: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric squared distances of unit vectors to coded vectors of one list."""
        rest = x - self.centres[own]
        total = np.zeros((len(x), len(codes)), np.float32)
        for p, (a, b) in enumerate(zip(self.cuts, self.cuts[1:], strict=False)):
            part = rest[:, a:b]
            table = _nearest(part, self.books[p]) + (part * part).sum(1)[:, None]
            total += table.astype(np.float32)[:, codes[:, p]]
        return total


def _join(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Merges the parts of ``i`` and ``j``; every label stays the smallest member of its part."""
    while True:
        a, b = label[i], label[j]
        if (a == b).all():
            return label
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]


def _linker(index, radius: float, cosine: float):
    """Counts and edges of a pair of blocks: role 1 rows against role 0 rows; a block with itself: role 0 rows against each other."""

    def link(cell: pd.DataFrame) -> pd.DataFrame:
        cell = cell.sort_values("role", kind="stable")
        n = int((cell["role"] == 0).sum())
        raw = np.stack(cell["vec"].to_list()).astype(np.float64)
        norm = np.sqrt((raw * raw).sum(1))
        unit = raw / norm[:, None]
        rep, copies = cell["rep"].to_numpy(), cell["copies"].to_numpy()
        model = index.value.get(raw.shape[1])
        if model is not None and n:
            codes = np.stack([np.frombuffer(c, np.uint8) for c in cell["codes"].iloc[:n]])
            bound = (radius + cell["left"].to_numpy()[:n] + 1e-3) ** 2
        count = np.zeros(len(cell), np.int64)
        label = np.arange(len(cell))
        lower = 0 if cell["i"].iloc[0] == cell["j"].iloc[0] else n
        for start in range(lower, len(cell) if n else 0, 256):
            x = unit[start : start + 256]
            if model is None:
                i, j = np.nonzero(x @ unit[:n].T >= cosine - 1e-9)
            else:
                i, j = np.nonzero(model.distances(x, int(cell["list"].iloc[0]), codes) <= bound)
            i = i + start
            once = (i >= n) | (j > i)
            i, j = i[once], j[once]
            for s in range(0, len(i), 100_000):
                a, b = i[s : s + 100_000], j[s : s + 100_000]
                near = (raw[a] * raw[b]).sum(1) >= cosine * norm[a] * norm[b]
                a, b = a[near], b[near]
                np.add.at(count, a, copies[b])
                np.add.at(count, b, copies[a])
                label = _join(label, a, b)
        linked, moved = count > 0, label != np.arange(len(cell))
        return pd.DataFrame(
            {
                "a": np.concatenate([rep[linked], rep[moved]]),
                "b": np.concatenate([rep[linked], rep[label[moved]]]),
                "n": np.concatenate([count[linked], np.zeros(moved.sum(), np.int64)]),
            }
        )

    return link


def fit(reps: DataFrame, n: int, sample_rows: int, lists: int, seed: int = 1, sample_bytes: int = 128 << 20) -> dict[int, Index]:
    """An index for each vector length of a sample of about ``sample_rows`` rows that has over 64 of them; {} for an empty table.

    The sample takes ``sample_bytes`` at most on average, counted in double precision, so that long vectors bring fewer rows.
    """
    longest = reps.agg(F.max(F.size("vec"))).first()[0] or 1
    share = min(1.0, min(sample_rows, sample_bytes // (8 * longest)) / max(1, n))
    chosen = reps.where(F.pmod(F.xxhash64(F.lit(seed), "rep"), F.lit(1 << 30)) < int(share * (1 << 30)))  # ids are distinct
    rows = chosen.select("rep", "vec").toArrow().sort_by("rep").column("vec").combine_chunks()
    sizes = rows.value_lengths().to_numpy(zero_copy_only=False)
    found = {}
    for dim in np.unique(sizes).tolist():
        part = rows.filter(pa.array(sizes == dim))
        if len(part) > 64:
            x = part.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            found[dim] = Index(x / np.sqrt((x * x).sum(1))[:, None], max(1, round(lists * len(part) / len(rows))), seed=seed)
    return found


def near_duplicates(vectors: DataFrame, cosine: float = 0.98, sample_rows: int = 20_000, block: int = 2048, slack: float | None = None, list_rows: int = 1024, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """``vec_id, n_links, component_id`` of every row."""
    radius = math.sqrt(2 - 2 * cosine)
    vec = F.col(embedding)
    double = F.transform(vec, lambda x: x.cast("double"))
    square = F.aggregate(double, F.lit(0.0), lambda s, x: s + x * x)
    finite = F.forall(double, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(F.col(label).isNotNull() & finite & (square > 0), F.lit(False))
    plain = F.transform(vec, lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x.cast("double")))
    rows = cut(
        vectors.select(
            F.col(vec_id).alias("vec_id"),
            F.when(usable, F.col(label)).alias("label"),
            F.when(usable, vec).alias("vec"),
            F.when(usable, F.xxhash64(plain)).alias("h1"),
            F.when(usable, F.xxhash64(F.lit(7), plain)).alias("h2"),
        )
    )
    key = ["label", "h1", "h2"]
    reps = cut(
        rows.where("vec IS NOT NULL AND vec_id IS NOT NULL")
        .groupBy(*key)
        .agg(F.min("vec_id").alias("rep"), F.min_by("vec", "vec_id").alias("vec"), F.count_distinct("vec_id").alias("copies"))
    )
    n = reps.count()
    lists = min(16_384, max(1, n // list_rows))
    index = vectors.sparkSession.sparkContext.broadcast(fit(reps, n, max(sample_rows, 8 * lists), lists))  # at most 16,384 lists
    reach = lambda dim: radius if slack is None else radius * min(1.0, slack / math.sqrt(dim))

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch.assign(dim=batch["vec"].map(len), list=0, codes=b"", left=0.0, probes=[[] for _ in range(len(batch))])
            for dim, part in batch.groupby("dim"):
                model = index.value.get(dim)
                if model is not None:
                    x = np.stack(part["vec"].to_list()).astype(np.float64)
                    own, codes, left, probes = model.encode(x / np.sqrt((x * x).sum(1))[:, None], reach(dim))
                    part = part.assign(list=own, codes=[c.tobytes() for c in codes], left=left, probes=probes)
                yield part

    kind = reps.schema["label"].dataType.simpleString()
    indexed = cut(
        reps.select("label", "rep", "vec", "copies").mapInPandas(
            encode, f"label {kind}, rep long, vec {reps.schema['vec'].dataType.simpleString()}, copies long, dim int, list int, codes binary, left double, probes array<int>"
        )
    )
    cell = CELL[:3]
    reach = indexed.select("label", "dim", F.explode("probes").alias("list"), "rep", "copies", "vec")
    blocks = lambda name: F.ceil(F.count("*") / block).cast("int").alias(name)
    cells = indexed.groupBy(*cell).agg(blocks("blocks")).join(reach.groupBy(*cell).agg(blocks("more")), cell, "left").na.fill(0, ["more"])
    deal = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    dealt = indexed.join(cells, cell).withColumn("mine", deal("blocks"))
    row = ["rep", "copies", "vec", "codes", "left"]
    own = dealt.select(*cell, F.col("mine").alias("i"), F.explode(F.sequence(F.col("mine"), F.col("blocks") + F.col("more") - 1)).alias("j"), *row, F.lit(0).alias("role")).unionByName(
        dealt.where("mine > 0").select(*cell, F.explode(F.sequence(F.lit(0), F.col("mine") - 1)).alias("i"), F.col("mine").alias("j"), *row, F.lit(1).alias("role"))
    )
    probing = (
        reach.join(cells, cell)
        .withColumn("j", F.col("blocks") + deal("more"))
        .withColumn("i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(*CELL, "rep", "copies", "vec", F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("double").alias("left"), F.lit(1).alias("role"))
    )
    met = cut(own.unionByName(probing).groupBy(*CELL).applyInPandas(_linker(index, radius, cosine), "a long, b long, n long"))
    found = components(met.where("n = 0").select("a", "b")).withColumnRenamed("node", "rep")
    counted = met.where("n > 0").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("far"))
    groups = cut(
        reps.select(*key, "rep", "copies")
        .join(found, "rep", "left")
        .join(counted, "rep", "left")
        .select(*key, F.coalesce("component", "rep").alias("component_id"), (F.coalesce("far", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    )
    return rows.drop("vec").join(groups, key, "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")
    )
