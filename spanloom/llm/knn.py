"""Exact top-k by a Voronoi join.

1. *Pivots*: vectors chosen by hash, as many as the root of the number of vectors (``PIVOTS`` at most),
   cut the space into cells; every vector, query or not, belongs to the cell of its nearest pivot.
2. *Summaries*: each cell's pivot, count, and radius (the largest distance of a member
   from the pivot). Their number is that of the pivots, so the driver holds and broadcasts them.
3. *Bounds*: a member x of a cell with pivot p and radius r has
   ``q.p - |q| r <= q.x <= q.p + |q| r``. The lower bounds and the counts of the cells
   give each query a score that at least k candidates reach; a cell whose upper bound is
   below it holds no answer. Solving a query in its own cell first raises that score to
   the k-th best found there. Bounds are doubles, widened by more than their rounding can
   be: a share ``EPS`` per component of the magnitudes that went into them.
4. *Replication*: a query goes to the cells which its bounds leave, and to no others.
   Cells are dealt in blocks of rows by a hash, so a crowded cell is many tasks; a block meets
   the queries sent to it in blocks of queries, with one matrix product each.

Vectors become integers, ``floor(scale * x)``, in double precision. Products are exact in doubles while
dim * max|x|^2 stays under 2**53. In a table with larger ones the double product only picks the candidates that
may be among the best; those are scored in Python's integers and ranked by them (``wide``). What does not fit a long counts as the
end of its range: a component before the product, a score after ranking.

Edge cases: vectors that are null, empty, hold null or non-finite components, or have another
length than the commonest valid one's (the longer on a tie), take no part; nor do rows without an id. A row is known by its id: rows that
share an id are one query, which asks with the least of their vectors, and none of them is its candidate. Fewer than k candidates give fewer rows.
Ties go to the smaller id; equal rows are ranked one after another. An empty table gives no rows. Columns other than vec_id and embedding are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.llm.common import cut

#: Pivots at most, rows of a cell's block and queries of a block (bounds of what a task or the driver holds).
PIVOTS, BLOCK, QUERIES = 4096, 2048, 2048
#: Slack of a bound, for each component, as a share of the magnitudes in it; candidate keys' offset and bytes.
EPS, OFFSET, WIDE = 2.0**-48, 1 << 255, 32
#: Ends of the range of a long.
LOW, HIGH = -(2**63), 2**63 - 1


def _whole(vectors: DataFrame, scale: int) -> DataFrame:
    """(vec_id, v): valid vectors as arrays of long."""
    v = F.col("embedding")
    ok = F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return vectors.filter(ok).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x.cast("double") * scale)).alias("v"))


def _matrix(column) -> np.ndarray:
    flat = column.flatten() if hasattr(column, "flatten") else column
    return np.asarray(flat).reshape(len(column), -1)


def _top_mask(scores: np.ndarray, k: int) -> np.ndarray:
    """Which of each row's entries are its k greatest, the first columns on a tie."""
    n = scores.shape[1]
    if n <= k:
        return np.ones(scores.shape, bool)
    edge = np.partition(scores, n - k, axis=1)[:, n - k][:, None]
    above, level = scores > edge, scores == edge
    return above | level & (np.cumsum(level, axis=1) <= k - above.sum(1)[:, None])


def _best(q: np.ndarray, x: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int, exact: bool) -> tuple[list[int], list[int], list[int], list[bytes | None]]:
    """(query row, id, score, key) of the k best of ``x`` for each row of ``q``; ties to the smaller id; a query's own id is left out."""
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    a, b = q.astype(np.float64), x.astype(np.float64)
    near = a @ b.T
    near[own[:, None] == ids[None, :]] = -np.inf
    if exact:
        rows, cols = np.nonzero(_top_mask(near, k) & (near > -np.inf))
        return rows.tolist(), ids[cols].tolist(), near[rows, cols].astype(np.int64).tolist(), [None] * len(rows)
    # doubles are off by no more than this: whoever reaches the k-th best less twice that is scored in integers
    off = (q.shape[1] + 8) * EPS * np.sqrt((a**2).sum(1)) * np.sqrt((b**2).sum(1).max(initial=0))
    out: tuple[list, list, list, list] = [], [], [], []
    for r in range(len(near)):
        edge = np.partition(near[r], max(0, near.shape[1] - k))[max(0, near.shape[1] - k)] if near.shape[1] else -np.inf
        cols = np.flatnonzero((near[r] >= edge - 2 * off[r]) & (near[r] > -np.inf))
        mine = q[r].tolist()
        found = sorted((-sum(u * v for u, v in zip(mine, x[c].tolist(), strict=True)), int(ids[c])) for c in cols.tolist())[:k]
        for s, i in found:
            out[0].append(r)
            out[1].append(i)
            out[2].append(min(HIGH, max(LOW, -s)))
            out[3].append((OFFSET - s).to_bytes(WIDE, "big"))
    return out


def _assign(pivots: np.ndarray):
    """Cell of every vector, by one product of a batch with the pivots, and a bound of its distance from the cell's pivot."""
    centres = pivots.astype(np.float64)
    norms = (centres**2).sum(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column(1)).astype(np.float64)
            size = (x**2).sum(1)
            d = size[:, None] + norms - 2 * (x @ centres.T)
            cell = d.argmin(1)
            slack = (x.shape[1] + 8) * EPS * (size + norms[cell])
            far = np.sqrt(np.maximum(d[np.arange(len(d)), cell], 0) + 2 * slack)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cell, pa.int32()), pa.array(far, pa.float64())], names=["vec_id", "v", "cell", "far"])

    return run


def _needed(pivots: np.ndarray, radius: np.ndarray, count: np.ndarray, k: int):
    """Cells that may hold an answer to each query: upper bounds against the score that k candidates are known to reach."""
    centres = pivots.astype(np.float64)
    length = np.sqrt((centres**2).sum(1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            q = _matrix(b.column("v")).astype(np.float64)
            size = np.sqrt((q**2).sum(1))[:, None]
            slack = (q.shape[1] + 8) * EPS * size * (length + radius)
            mid, reach = q @ centres.T, size * radius + slack
            low, high = mid - reach, mid + reach
            floor = b.column("floor").to_numpy(zero_copy_only=False).astype(np.float64)  # NaN where its own cell gave fewer than k
            floor -= np.abs(floor) * EPS
            order = np.argsort(-low, axis=1)
            have = np.cumsum(count[order], axis=1) >= k + 1  # one of them may be the query itself
            first = have.argmax(1)
            bound = np.where(have.any(1), low[np.arange(len(q)), order[np.arange(len(q)), first]], -math.inf)
            keep = (high >= np.fmax(bound, floor)[:, None]) & (count > 0)
            rows, cells = np.nonzero(keep)
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("vec_id").take(take), b.column("v").take(take), pa.array(cells, pa.int32())], names=["query_id", "v", "cell"])

    return run


FOUND = "query_id long, vec_id long, score long, wide binary"


def _solve(k: int, exact: bool):
    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        rows, found = [], ([], [], [], [])
        if left.num_rows and right.num_rows:
            own = left["query_id"].to_numpy()
            q, x = (_matrix(t.combine_chunks()) for t in (left["v"], right["x_v"]))
            found = _best(q, x, right["x_vec_id"].to_numpy(), own, k, exact)
            rows = own[found[0]].tolist()
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.table([pa.array(c, t) for c, t in zip((rows, *found[1:]), kinds, strict=True)], names=["query_id", "vec_id", "score", "wide"])

    return run


def _join(queries: DataFrame, data: DataFrame, blocks: DataFrame, k: int, exact: bool) -> DataFrame:
    """Candidates (query_id, vec_id, score, wide): each query (query_id, v, cell) against all blocks of its cell."""
    # a cell's queries are dealt in blocks as well; both counts come from one row a cell
    per_cell = queries.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("n_q")).join(blocks, "cell")
    small = F.broadcast(per_cell)  # a row a cell: as many as pivots, at most
    left = queries.join(small, "cell").withColumn("q", F.pmod(F.xxhash64("query_id"), "n_q").cast("int"))
    left = left.withColumn("b", F.explode(F.sequence(F.lit(0), F.col("n_b") - 1))).select("cell", "b", "q", "query_id", "v")
    right = data.join(small, "cell").withColumn("b", F.pmod(F.xxhash64("vec_id", "v"), "n_b").cast("int"))
    right = right.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("n_q") - 1))).select("cell", "b", "q", "vec_id", "v")
    right = right.toDF(*(f"x_{c}" for c in right.columns))  # both sides stem from one table: other names tell them apart
    return left.groupBy("cell", "b", "q").cogroup(right.groupBy("x_cell", "x_b", "x_q")).applyInArrow(_solve(k, exact), FOUND)


def _top(candidates: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.col("wide").desc(), F.col("score").desc(), "vec_id")
    return candidates.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, scale: int = 256, pivots: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best candidates of each row whose id ``every`` divides."""
    spark = vectors.sparkSession
    out = "query_id long, rank int, vec_id long, score long"
    whole = _whole(vectors.select("vec_id", "embedding"), scale)
    most = F.max(F.greatest(F.array_max("v").cast("double"), -F.array_min("v").cast("double")))
    sizes = whole.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n"), most.alias("most"))
    top = sizes.orderBy(F.col("n").desc(), F.col("dim").desc()).first()
    if top is None:
        return spark.createDataFrame([], out)
    dim, exact = top["dim"], top["dim"] * top["most"] ** 2 < 2.0**53
    whole = whole.filter(F.size("v") == dim)
    pivots = pivots or min(PIVOTS, max(16, math.isqrt(top["n"])))
    # equal vectors hash alike: distinct ones first, so that copies of one do not take all pivots
    chosen = whole.groupBy(F.xxhash64("v").alias("h")).agg(F.min("v").alias("v")).orderBy("h").limit(pivots).collect()
    centres = np.array([r["v"] for r in chosen], np.int64)
    dealt = cut(whole.mapInArrow(_assign(centres), "vec_id long, v array<long>, cell int, far double"))
    summary = dealt.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("r")).collect()
    count, radius = np.zeros(len(centres), np.int64), np.zeros(len(centres))
    for s in summary:
        count[s["cell"]], radius[s["cell"]] = s["n"], s["r"]
    blocks = spark.createDataFrame(pd.DataFrame({"cell": range(len(count)), "n_b": [max(1, math.ceil(n / BLOCK)) for n in count]}), "cell int, n_b int")
    data = dealt.select("vec_id", "v", "cell")
    one = data.filter(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.min(F.struct("v", "cell")).alias("q"))
    at_home = one.select("query_id", "q.v", "q.cell")
    first = cut(_top(_join(at_home, data, blocks, k, exact), k))
    floors = first.filter((F.col("rank") == k) & (F.col("score") > LOW)).select("query_id", F.col("score").cast("double").alias("floor"))
    asked = at_home.join(floors, "query_id", "left").select(F.col("query_id").alias("vec_id"), "v", "cell", "floor")
    sent = asked.mapInArrow(_needed(centres, radius, count, k), "query_id long, v array<long>, cell int")
    home = at_home.select("query_id", "cell")
    away = sent.join(home, ["query_id", "cell"], "left_anti").select("query_id", "v", "cell")
    both = first.select("query_id", "vec_id", "score", "wide").unionByName(_join(cut(away), data, blocks, k, exact))
    return _top(both, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
