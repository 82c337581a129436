"""Exact nearest neighbours by squared Euclidean distance.

A table of one block is compared whole. A larger one is dealt into cells around pivots,
and the triangle inequality says which cells a query need not see:

1. Every vector goes to its nearest pivot; a cell's radius is its farthest vector's distance.
2. A query first meets the nearest cells that hold k vectors. Its k-th distance there is a bound.
3. It then meets those other cells only whose pivot is not farther than bound plus radius.

No neighbour is lost, however the vectors lie; how many cells a query meets depends on
them (``reach`` measures it). Cells of any size are dealt into blocks by hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.scratch import written


def checked(vectors: DataFrame, chunk_id: str = "chunk_id", strict: bool = False) -> DataFrame:
    """Rows with an id and a vector; of rows repeating an id the last by ``added`` (if there) stays. With ``strict`` a row without one is an error."""
    fits = F.col(chunk_id).isNotNull() & F.col("embedding").isNotNull()
    wrong = F.raise_error(F.concat(F.lit("a vector needs an id and components: "), F.coalesce(F.col(chunk_id).cast("string"), F.lit("no id"))))
    held = vectors.where(F.when(fits, True).otherwise(wrong.cast("boolean")) if strict else fits)
    if "added" not in vectors.columns:
        return held.dropDuplicates([chunk_id])
    order = W.partitionBy(chunk_id).orderBy(F.desc("added"))
    return held.withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")


def dimensions(vectors: DataFrame) -> DataFrame:
    return vectors.groupBy(F.size("embedding").alias("dimension")).agg(F.count("*").alias("n_vectors"))


#: Pivots of a table, and the bytes that they may take: they go to the driver and to every worker.
PIVOTS, PIVOT_BYTES = 1024, 64 << 20
#: What bounds give away to rounding.
MARGIN = 1e-6


def _matrix(table: pa.Table | pa.RecordBatch) -> np.ndarray:
    column = table.column("embedding")
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _whole(rows: DataFrame, same: str | None) -> DataFrame:
    """Rows with a vector whose components are all numbers, and with a value to be the same, where one is named."""
    rows = rows.select(*[F.col(c).alias(c) for c in rows.columns])  # vectors may be their own queries
    fits = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(fits & F.col(same).isNotNull() if same else fits)


def choose_pivots(vectors: DataFrame, n: int, seed: int = 1) -> dict[int, np.ndarray]:
    """Pivots by vector length: some root-of-n rows drawn by a hash of the id, at most ``PIVOTS`` and ``PIVOT_BYTES``."""
    longest = vectors.agg(F.max(F.size("embedding"))).first()[0] or 1
    count = max(1, min(PIVOTS, PIVOT_BYTES // (8 * longest), int(n**0.5)))
    order = F.xxhash64(F.lit(seed), "chunk_id")
    rows = vectors.select("embedding", order.alias("o")).orderBy("o").limit(count).toArrow()
    sizes = rows.column("embedding").combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
    return {int(d): _matrix(rows.filter(pa.array(sizes == d))) for d in np.unique(sizes) if d}


def _away(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Distances of rows to centres, as differences, so that no cancellation spoils a bound."""
    return np.stack([np.sqrt(((x - c) ** 2).sum(1)) for c in centres], 1)


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    sizes = batch.column("embedding").value_lengths().to_numpy(zero_copy_only=False)
    for d in np.unique(sizes):
        yield int(d), batch.filter(pa.array(sizes == d))


def _nearest(k: int, same: str | None):
    """The best ``k`` (and ties) of a block of vectors for each of a block of queries."""

    def nearest(own: pa.Table, asked: pa.Table) -> pa.Table:
        none = pa.table({"query_id": asked.column("query_id").slice(0, 0), "chunk_id": own.column("chunk_id").slice(0, 0), "l2sq": pa.array([], pa.float64())})
        if not own.num_rows or not asked.num_rows:
            return none
        x, q = _matrix(own), _matrix(asked)
        rows, columns, found = [], [], []
        bounds = (x * x).sum(1), 1e-9 * (1 + (x * x).sum(1).max())
        if same:
            values = pa.concat_arrays([own.column(same).combine_chunks(), asked.column(same).combine_chunks()]).dictionary_encode().indices.to_numpy()
            mine, theirs = values[: len(x)], values[len(x) :]
        for start in range(len(q)):
            rough = bounds[0] - 2 * (x @ q[start]) + q[start] @ q[start]  # close, but not as exact as differences
            if same:
                rough = np.where(mine == theirs[start], rough, np.inf)
            place = min(k, len(rough)) - 1
            some = np.flatnonzero((rough <= np.partition(rough, place)[place] + 1e-5 + bounds[1]) & np.isfinite(rough))
            d = np.round(((x[some] - q[start]) ** 2).sum(1), 6)
            if len(d) > k:
                some, d = some[d <= np.partition(d, k - 1)[k - 1]], d[d <= np.partition(d, k - 1)[k - 1]]
            rows.append(np.full(len(some), start))
            columns.append(some)
            found.append(d)
        return pa.table(
            {
                "query_id": asked.column("query_id").take(pa.array(np.concatenate(rows))),
                "chunk_id": own.column("chunk_id").take(pa.array(np.concatenate(columns))),
                "l2sq": pa.array(np.concatenate(found)),
            }
        )

    return nearest


def _meet(placed: DataFrame, asked: DataFrame, k: int, block: int, same: str | None) -> DataFrame:
    """``query_id, chunk_id, l2sq``: vectors (``dim, cell, chunk_id, embedding``) against the queries that come to their cell, in blocks of both sides."""
    cell, extra = ["dim", "cell"], [same] if same else []
    blocks = lambda rows, name: rows.groupBy(*cell).agg(F.ceil(F.count("*") / block).cast("int").alias(name))
    sizes = blocks(placed, "nv").join(blocks(asked, "nq"), cell)
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = placed.join(sizes, cell).withColumns({"vb": deal("chunk_id", "nv")}).select(*cell, "vb", every("nq").alias("qb"), "chunk_id", "embedding", *extra)
    right = asked.join(sizes, cell).withColumns({"qb": deal("query_id", "nq")}).select(*cell, "qb", every("nv").alias("vb"), "query_id", "embedding", *extra)
    kinds = f"query_id {asked.schema['query_id'].dataType.simpleString()}, chunk_id {placed.schema['chunk_id'].dataType.simpleString()}, l2sq double"
    key = [*cell, "vb", "qb"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_nearest(k, same), kinds)


def _cells(vectors: DataFrame, queries: DataFrame, pivots: dict[int, np.ndarray], same: str | None) -> tuple[DataFrame, DataFrame]:
    """Vectors with ``dim, cell, away``, and for every query the cells (with ``n, radius``) by distance ``d`` to their pivot."""
    held = vectors.sparkSession.sparkContext.broadcast(pivots)  # PIVOT_BYTES at most
    extra = [same] if same else []

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, part in _by_length(batch):
                d = _away(_matrix(part), held.value[dim]) if dim in held.value else np.zeros((part.num_rows, 1))
                cell = d.argmin(1)
                more = [pa.array(np.full(len(cell), dim, np.int32)), pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(cell)), cell])]
                yield pa.RecordBatch.from_arrays([*part.columns, *more], [*part.schema.names, "dim", "cell", "away"])

    def approach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, part in _by_length(batch):
                d = _away(_matrix(part), held.value[dim]) if dim in held.value else np.zeros((part.num_rows, 1))
                at, cell = np.divmod(np.arange(d.size), d.shape[1])
                kept = [part.column(c).take(pa.array(at)) for c in ("query_id", *extra)]
                more = [pa.array(np.full(d.size, dim, np.int32)), pa.array(cell.astype(np.int32)), pa.array(d.ravel())]
                yield pa.RecordBatch.from_arrays([*kept, *more], ["query_id", *extra, "dim", "cell", "d"])

    shape = lambda rows, names: ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in names)
    own = vectors.select("chunk_id", "embedding", *extra)
    placed = written(own.mapInArrow(place, f"{shape(own, own.columns)}, dim int, cell int, away double"))
    asked = queries.select("query_id", *extra, "embedding").mapInArrow(approach, f"{shape(queries, ['query_id', *extra])}, dim int, cell int, d double")
    stats = placed.groupBy(*extra, "dim", "cell").agg(F.count("*").alias("n"), F.max("away").alias("radius"))
    return placed, written(asked.join(stats, [*extra, "dim", "cell"]))


def _rounds(vectors: DataFrame, queries: DataFrame, k: int, block: int, same: str | None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Placed vectors, the first cells of every query with what it finds there, and the further cells that it has to see."""
    placed, ways = _cells(vectors, queries, choose_pivots(vectors, vectors.count()), same)
    near = W.partitionBy("query_id").orderBy("d", "cell")
    before = F.coalesce(F.sum("n").over(near.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    marked = written(ways.withColumn("first", before < k))
    first = marked.where("first").select("query_id", "dim", "cell")
    met = written(_meet(placed, first.join(queries, "query_id"), k, block, same))
    nth = met.withColumn("nth", F.row_number().over(W.partitionBy("query_id").orderBy("l2sq")))
    bound = nth.where(F.col("nth") == k).select("query_id", F.sqrt("l2sq").alias("bound"))
    rest = marked.where("NOT first").join(bound, "query_id", "left")
    more = rest.where(F.col("bound").isNull() | (F.col("d") <= F.col("bound") + F.col("radius") + MARGIN * (1 + F.col("d")))).select("query_id", "dim", "cell")
    return placed, first, met, written(more)


def reach(vectors: DataFrame, queries: DataFrame, k: int = 10, block: int = 4096, same: str | None = None) -> DataFrame:
    """``query_id, n_vectors, n_met``: the vectors of a query's length (and value), and those in the cells that it meets."""
    vectors, queries = _whole(vectors, same), _whole(queries, same)
    placed, first, _, more = _rounds(vectors, queries, k, block, same)
    extra = [same] if same else []
    sizes = placed.groupBy(*extra, "dim", "cell").agg(F.count("*").alias("n"))
    asked = queries.select("query_id", F.size("embedding").alias("dim"), *extra)
    every = asked.join(sizes, ["dim", *extra]).groupBy("query_id").agg(F.sum("n").alias("n_vectors"))
    met = first.unionByName(more).join(asked, ["query_id", "dim"]).join(sizes, ["dim", "cell", *extra]).groupBy("query_id").agg(F.sum("n").alias("n_met"))
    return every.join(met, "query_id")


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, block: int = 4096, same: str | None = None) -> DataFrame:
    """``query_id, chunk_id, l2sq, rank``: the ``k`` nearest vectors of every query.

    ``same`` names a column that must be equal on both sides; rows where it is null are left
    out. Distances are rounded to six places; ties go to the smaller id. Null vectors, vectors with
    a null, NaN or infinite component and queries like that are left out; a query meets vectors of its own
    length only. Query ids are distinct.
    """
    vectors, queries = _whole(vectors, same), _whole(queries, same)
    if vectors.count() <= block:
        one = lambda rows: rows.withColumns({"dim": F.size("embedding"), "cell": F.lit(0)})
        met = _meet(one(vectors), one(queries), k, block, same)
    else:
        placed, _, met, more = _rounds(vectors, queries, k, block, same)
        met = met.unionByName(_meet(placed, more.join(queries, "query_id"), k, block, same))
    order = W.partitionBy("query_id").orderBy("l2sq", "chunk_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
