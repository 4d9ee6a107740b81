"""Exact top-k search by vector-approximation files.

Each dimension is cut into 256 cells at the quantiles of a bounded sample; the
file holds one byte for each component, in shards.  For a query, a table of
the least and greatest product with each cell of each dimension is made; the
entries of a vector's cells, added up, bound its inner product on both sides.
A scan of the cells alone returns the vectors whose upper bound reaches the
k-th largest lower bound.  Exact vectors are read for these only, in the order
of their bounds: the first few of each query, then those whose upper bound
reaches the k-th result so far, after which that result is certain.

Equal vectors are one entry of the file, with their smallest ids: more of them
than results can't be in any result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm._util import Shared, checkpoint, tidy

SHARD_ROWS = 65_536
QUERY_ROWS = 16_384
CELLS = 256
#: Components of the vectors that the cells' edges are learned from; the expected number.
SAMPLE = 1_000_000
AT_ONCE, ROWS_AT_ONCE = 16, 4_096
#: Vectors read at first, for each result asked for.
READ_FIRST = 4
LEAST, MOST = -(2**63), 2**63 - 1
KEY = ["same", "twin"]


def quantised(vectors: DataFrame, scale: int, id_column: str, column: str) -> DataFrame:
    """vec_id, v (floor(scale * x) of each component, x as double), dim, and a key of v; without vectors that are null or hold null or non-finite components, before or after."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    doubles = F.transform(F.col(column).cast("array<double>"), lambda c: c * F.lit(float(scale)))
    sound = F.col(column).isNotNull() & F.forall(doubles, finite)
    # A double of 2^52 and more is whole; floor() would go through long.
    whole = F.transform(doubles, lambda c: F.when(F.abs(c) < F.lit(2.0**52), F.floor(c).cast("double")).otherwise(c))
    kept = vectors.where(F.col(id_column).isNotNull() & F.coalesce(sound, F.lit(False))).select(F.col(id_column).cast("long").alias("vec_id"), whole.alias("v"))
    return kept.select("vec_id", "v", F.size("v").alias("dim"), F.xxhash64("v").alias("same"), F.xxhash64(F.lit(1), "v").alias("twin"))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


class Cells:
    """The cells of vectors of one length: `low` and `high` (dimension, cell) are the least and greatest component of a cell."""

    def __init__(self, sample: np.ndarray, low: np.ndarray, high: np.ndarray):
        inner = np.quantile(sample, np.arange(1, CELLS) / CELLS, axis=0, method="lower") if len(sample) else np.zeros((0, len(low)))
        self.edges = inner.T.copy()
        self.low = np.concatenate([low[:, None], self.edges], axis=1)
        self.high = np.concatenate([self.edges, high[:, None]], axis=1)

    def of(self, exact: np.ndarray) -> np.ndarray:
        out = np.empty(exact.shape, np.uint8)
        for d, edges in enumerate(self.edges):
            out[:, d] = np.searchsorted(edges, exact[:, d], side="right")
        return out

    def bounds(self, cells: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lower, upper) bounds of each vector's inner product with each query: sums of entries of the queries' tables."""
        with np.errstate(over="ignore", invalid="ignore"):
            n = len(queries)
            ends = queries.T[:, None, :] * self.low[:, :, None], queries.T[:, None, :] * self.high[:, :, None]
            tables = np.concatenate([np.minimum(*ends), np.maximum(*ends)], axis=2)  # dimension, cell, twice the queries
            out = np.zeros((len(cells), 2 * n))
            for k in range(0, len(cells), ROWS_AT_ONCE):
                for d, table in enumerate(tables):
                    out[k : k + ROWS_AT_ONCE] += table[cells[k : k + ROWS_AT_ONCE, d]]
            # What rounding may have taken from a sum of that many terms.
            slack = 4 * (len(tables) + 1) * np.finfo(float).eps * (np.abs(queries) @ np.maximum(np.abs(self.low), np.abs(self.high)).max(axis=1))
            lower, upper = out[:, :n] - slack, out[:, n:] + slack
        lower[np.isnan(lower)], upper[np.isnan(upper)] = -np.inf, np.inf
        return np.clip(lower, LEAST, MOST), np.clip(upper, LEAST, MOST)


def products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The exact inner product of each row of q with that of v, held within the range of long."""
    with np.errstate(over="ignore"):
        size = np.abs(q).max(axis=1, initial=0) * np.abs(v).max(axis=1, initial=0) * max(1, q.shape[1])
    out = np.zeros(len(q), np.int64)
    small = size < 2.0**52
    out[small] = np.einsum("ij,ij->i", q[small], v[small]).astype(np.int64)
    for i in np.flatnonzero(~small):
        out[i] = max(LEAST, min(MOST, sum(int(a) * int(b) for a, b in zip(q[i].tolist(), v[i].tolist()))))
    return out


def cells_of(vectors: DataFrame) -> dict[int, Cells]:
    """The cells for each length of the vectors.

    Each task sends the ends of the components it saw, one row for each length;
    quantiles come from about SAMPLE components.
    """

    def ends(batches):
        held: dict[int, list] = {}
        for batch in batches:
            dims = batch.column(0).to_numpy()
            for dim in np.unique(dims):
                x = matrix(batch.column(1).filter(pa.array(dims == dim)), dim)
                n, low, high = held.get(dim, (0, np.inf, -np.inf))
                held[dim] = n + len(x), np.minimum(low, x.min(axis=0)), np.maximum(high, x.max(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array([int(d) for d in held], pa.int32()), pa.array([x[0] for x in held.values()], pa.int64()), pa.array([x[1].tolist() for x in held.values()], pa.list_(pa.float64())), pa.array([x[2].tolist() for x in held.values()], pa.list_(pa.float64()))], ["dim", "n", "low", "high"])

    low, high, n = {}, {}, 0
    for r in vectors.where("dim > 0").select("dim", "v").mapInArrow(tidy(ends), "dim int, n long, low array<double>, high array<double>").collect():
        d, a, b = r["dim"], np.array(r["low"]), np.array(r["high"])
        low[d], high[d] = np.minimum(low.get(d, a), a), np.maximum(high.get(d, b), b)
        n += r["n"] * d
    whole = 1 << 30
    chosen = vectors if n <= SAMPLE else vectors.where(F.pmod(F.xxhash64(F.lit(2), *KEY), F.lit(whole)) < int(whole * SAMPLE / n))
    found: dict[int, list] = {d: [] for d in low}
    for r in chosen.where("dim > 0").select("dim", "v").collect() if low else ():
        found[r["dim"]].append(r["v"])
    return {d: Cells(np.array(found[d], float).reshape(-1, d), low[d], high[d]) for d in low}


def candidates(entries: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """q_same, q_twin, same, twin, upper: the entries that the cells don't rule out for a query."""
    n, asked = entries.count(), queries.count()
    shards, blocks = max(12, math.ceil(n / SHARD_ROWS)), max(1, math.ceil(asked / QUERY_ROWS))
    cells = cells_of(entries)
    held = Shared(entries.sparkSession, cells)

    def write(batches):
        for batch in batches:
            dims = batch.column(2).to_numpy()
            for dim in np.unique(dims):
                some = batch.filter(pa.array(dims == dim))
                rows = held.value()[int(dim)].of(matrix(some.column(3), dim))
                yield pa.RecordBatch.from_arrays([*[some.column(i) for i in range(3)], pa.array([x.tobytes() for x in rows], pa.binary())], [*KEY, "dim", "cells"])

    file = entries.where("dim > 0").select(*KEY, "dim", "v").mapInArrow(tidy(write, held.key), "same long, twin long, dim int, cells binary")
    file = file.select("dim", F.pmod("same", F.lit(shards)).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), *KEY, "cells")
    asking = queries.where("dim > 0").select("dim", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), F.pmod("same", F.lit(blocks)).cast("int").alias("block"), *KEY, "v")
    names = ["q_same", "q_twin", "same", "twin", "lower", "upper"]

    def scan(left, right):
        out = [[] for _ in names]
        if left.num_rows and right.num_rows:
            dim = left.column("dim")[0].as_py()
            own = [left.column(c).to_numpy() for c in KEY]
            cells = np.frombuffer(b"".join(left.column("cells").to_pylist()), np.uint8).reshape(-1, dim)
            q = matrix(right.column("v"), dim)
            q_own = [right.column(c).to_numpy() for c in KEY]
            for a in range(0, len(q), AT_ONCE):
                lower, upper = held.value()[dim].bounds(cells, q[a : a + AT_ONCE])
                sure = np.partition(lower, len(lower) - k, axis=0)[len(lower) - k] if len(lower) > k else np.full(lower.shape[1], -np.inf)
                rows, at = np.nonzero(upper >= sure)
                for col, x in zip(out, (q_own[0][a + at], q_own[1][a + at], own[0][rows], own[1][rows], lower[rows, at], upper[rows, at])):
                    col.append(x)
        kinds = (np.int64,) * 4 + (float,) * 2
        return pa.table([np.concatenate(c) if c else np.zeros(0, t) for c, t in zip(out, kinds)], names=names)

    keys = ["dim", "shard", "block"]
    told = checkpoint(file.groupBy(*keys).cogroup(asking.groupBy(*keys)).applyInArrow(scan, "q_same long, q_twin long, same long, twin long, lower double, upper double"))
    sure = Window.partitionBy("q_same", "q_twin").orderBy(F.col("lower").desc())
    least = told.withColumn("place", F.row_number().over(sure)).where(F.col("place") <= k).groupBy("q_same", "q_twin").agg(F.min(F.when(F.col("place") == k, F.col("lower"))).alias("least"))
    return told.join(least, ["q_same", "q_twin"]).where(F.col("upper") >= F.coalesce("least", F.lit(float("-inf")))).select("q_same", "q_twin", *KEY, "upper")


def search(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best inner products of each vector whose id is divisible by `every`.

    Candidates are all rows but the query's own; ties go to the smaller vec_id;
    fewer candidates give fewer rows.  Vectors of another length than the
    query's are no candidates, nor are empty ones.  Rows alike in id and vector
    are one row; rows that share an id but not the vector are different rows,
    each a candidate of the others, and each such query has its own ranks.  Rows
    without an id, and vectors that are null or hold null or non-finite
    components (also after scaling), take no part; an empty table gives no
    rows.  A score beyond the range of long is held at its end, and ties there.
    Other columns are not read.
    """
    more = k + 1  # the query's own row may be among the best
    base = checkpoint(quantised(vectors, scale, id_column, column))
    entries = checkpoint(base.groupBy(*KEY).agg(F.any_value("dim").alias("dim"), F.any_value("v").alias("v")))
    members = checkpoint(base.select(*KEY, "vec_id").distinct())
    smallest = Window.partitionBy(*KEY).orderBy("vec_id")
    first = members.withColumn("place", F.row_number().over(smallest)).where(F.col("place") <= more).drop("place")
    asked = members.where(F.col("vec_id") % every == 0)
    queries = checkpoint(entries.join(asked.select(*KEY).distinct(), KEY, "left_semi"))
    found = checkpoint(candidates(entries, queries, more))

    def score(batches):
        for batch in batches:
            dims = batch.column(4).to_numpy()
            for dim in np.unique(dims):
                some = batch.filter(pa.array(dims == dim))
                yield pa.RecordBatch.from_arrays([*[some.column(i) for i in range(4)], pa.array(products(matrix(some.column(5), dim), matrix(some.column(6), dim)))], ["q_same", "q_twin", *KEY, "score"])

    def read(some: DataFrame) -> DataFrame:
        pairs = some.join(queries.select(F.col("same").alias("q_same"), F.col("twin").alias("q_twin"), F.col("v").alias("q")), ["q_same", "q_twin"]).join(entries, KEY)
        return pairs.select("q_same", "q_twin", *KEY, "dim", "q", "v").mapInArrow(tidy(score), "q_same long, q_twin long, same long, twin long, score long")

    by_bound = Window.partitionBy("q_same", "q_twin").orderBy(F.col("upper").desc(), *KEY)
    ordered = found.withColumn("place", F.row_number().over(by_bound))
    near = checkpoint(read(ordered.where(F.col("place") <= READ_FIRST * more)))
    by_score = Window.partitionBy("q_same", "q_twin").orderBy(F.col("score").desc())
    sure = near.withColumn("place", F.row_number().over(by_score)).where(F.col("place") == more).select("q_same", "q_twin", F.col("score").alias("least"))
    rest = ordered.where(F.col("place") > READ_FIRST * more).join(sure, ["q_same", "q_twin"]).where(F.col("upper") >= F.col("least").cast("double"))
    scored = near.unionByName(read(rest)).join(first, KEY)
    best = Window.partitionBy("q_same", "q_twin").orderBy(F.col("score").desc(), "vec_id", *KEY)
    top = scored.withColumn("place", F.row_number().over(best)).where(F.col("place") <= more)
    told = asked.select(F.col("vec_id").alias("query_id"), F.col("same").alias("q_same"), F.col("twin").alias("q_twin")).join(top, ["q_same", "q_twin"])
    told = told.where(~((F.col("query_id") == F.col("vec_id")) & (F.col("q_same") == F.col("same")) & (F.col("q_twin") == F.col("twin"))))
    order = Window.partitionBy("query_id", "q_same", "q_twin").orderBy("place")
    return told.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
