"""Exact top-k search by inner product as a Voronoi join.

Components are quantised to integers. Pivots (a bounded sample) part data and queries into cells. One pass over the data
gives each cell's summary: its count and the largest distance of a member from the pivot, and per norm. For a query q and a
cell with pivot c and radius r no member scores above q.c + |q| r, nor above |q| times the cell's largest norm.

1. Every query is solved in the cell that its bound ranks first among cells with at least k members, which gives it a
   floor: the score of its k-th answer there.
2. It is then sent only to the other cells whose bound reaches its floor, and solved there.

A cell is cut into blocks of bounded size by a hash of the id, so a hot cell is many tasks' work; a query visits all blocks
of its cells. Blocks return their own best k, which are merged in two steps. Bounds have slack for rounding, scores are
exact integers.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import written

#: Rows of a data block; queries that a task multiplies with it at once.
BLOCK_ROWS, QUERY_ROWS = 4096, 256
#: Blocks of one query whose results are merged together in the first step.
MERGE = 64


def quantised(vectors: DataFrame, id: str, vector: str, scale: int) -> DataFrame:
    """(id, v, dim): floor(scale * x) as doubles; rows whose vector is null or holds null, NaN or infinity are left out."""
    v = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * scale).cast("double"))
    finite = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    good = vectors.where(F.col(vector).isNotNull() & F.col(id).isNotNull()).where(finite)
    return good.select(F.col(id).cast("bigint").alias("id"), v.alias("v"), F.size(vector).alias("dim"))


def matrix(col: pa.Array, dim: int) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return np.asarray(col.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(col), dim)


def products(q: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in doubles while every partial sum stays below 2**53, else in Python integers."""
    if d.shape[1] and np.abs(q).max(initial=0) * np.abs(d).max(initial=0) * d.shape[1] < 2.0 ** 53:
        return (q @ d.T).astype(np.int64)
    wide = [[int(x) for x in row] for row in q], [[int(x) for x in row] for row in d]
    exact = [[sum(a * b for a, b in zip(x, y)) for y in wide[1]] for x in wide[0]]
    return np.array(exact, object).clip(-2 ** 63 + 2, 2 ** 63 - 1).astype(np.int64).reshape(len(q), len(d))


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Row-wise places of the k highest scores, ties to the smaller id. ids ascend."""
    if scores.shape[1] <= k:
        return np.argsort(-scores, axis=1, kind="stable")
    floor = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
    out = np.empty((len(scores), k), np.int64)
    for i, row in enumerate(scores):
        at = np.flatnonzero(row >= floor[i])
        out[i] = at[np.argsort(-row[at], kind="stable")[:k]]
    return out


def _solver(k: int):
    """For cogrouped blocks: (query, id, score) of each query's best k in the block; a query never meets its own row."""
    kinds = pa.schema([("query", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])

    def solve(queries: pa.Table, data: pa.Table) -> pa.Table:
        if not len(queries) or not len(data):
            return kinds.empty_table()
        ids = data["id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        dim = data["dim"][0].as_py()
        d, ids = matrix(data["v"], dim)[order], ids[order]
        q, asked = matrix(queries["v"], dim), queries["id"].to_numpy()
        out = []
        for a in range(0, len(q), QUERY_ROWS):
            score = products(q[a:a + QUERY_ROWS], d)
            own = asked[a:a + QUERY_ROWS, None] == ids[None, :]
            score = np.where(own, np.iinfo(np.int64).min + 1, score)  # its negative is an integer too
            at = best_of(score, ids, k + 1)
            got = np.take_along_axis(score, at, axis=1)
            keep = ~np.take_along_axis(own, at, axis=1)
            keep &= np.cumsum(keep, axis=1) <= k
            row, col = np.nonzero(keep)
            out.append((asked[a:a + QUERY_ROWS][row], ids[at[row, col]], got[row, col]))
        return pa.table([np.concatenate(c) for c in zip(*out)], schema=kinds)

    return solve


def _merged(found: DataFrame, k: int) -> DataFrame:
    """Best k rows (query, id, score) of each query, in two steps so that no task gets all blocks of a query at once."""
    order = [F.desc("score"), F.asc("id")]
    part = found.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(MERGE)))
    first = part.withColumn("r", F.row_number().over(Window.partitionBy("query", "part").orderBy(*order))).where(F.col("r") <= k)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k).select("query", "rank", "id", "score")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, id: str = "vec_id", vector: str = "embedding", scale: int = 1024,
          pivots: int = 64) -> DataFrame:
    """(query_id, rank, <id>, score): each query's k highest integer inner products with rows of another id. Runs jobs.

    Both tables have id and vector. All candidates if there are fewer than k; equal scores go to the smaller id. Null ids
    and vectors that are null or hold null or non-finite components take no part; vectors meet only those of their own
    length. Repeated candidate rows each count, repeated query rows answer once. Empty tables give no rows; other columns
    are not read. ``pivots`` bounds the sample of pivots.
    """
    data = written(quantised(vectors, id, vector, scale), "vectors")
    asked = quantised(queries, id, vector, scale).dropDuplicates(["id"])
    # pivots rows at most, the same for every run
    chosen = data.withColumn("h", F.xxhash64("id", F.lit(3))).orderBy("h", "id").limit(pivots).collect()
    by_dim: dict[int, np.ndarray] = {}
    for row in chosen:
        by_dim.setdefault(row["dim"], []).append(row["v"])
    by_dim = {d: np.unique(np.array(v, float).reshape(len(v), d), axis=0) for d, v in by_dim.items() if d}

    def assign(batches):
        for batch in batches:
            ids, dims = batch.column(0), batch.column(2).to_numpy(zero_copy_only=False)
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                v = matrix(batch.column(1).take(pa.array(rows)), dim)
                centre = by_dim.get(int(dim), np.zeros((1, dim)))
                far = np.maximum((v * v).sum(1)[:, None] - 2 * v @ centre.T + (centre * centre).sum(1)[None, :], 0)
                cell = far.argmin(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(rows)), batch.column(1).take(pa.array(rows)), pa.array(np.full(len(rows), dim, np.int32)), pa.array(cell.astype(np.int32)),
                     pa.array(np.sqrt(((v - centre[cell]) ** 2).sum(1))), pa.array(np.sqrt((v * v).sum(1)))],
                    names=["id", "v", "dim", "cell", "far", "norm"])

    celled = written(data.mapInArrow(assign, "id bigint, v array<double>, dim int, cell int, far double, norm double"), "cells")
    # one row per pivot and length; lengths that no pivot has make one cell each
    summary = celled.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("far").alias("radius"), F.max("norm").alias("norm")).collect()
    cells: dict[int, list] = {}
    for r in sorted(summary):
        cells.setdefault(r["dim"], []).append(tuple(r)[1:])
    blocks = {(d, c[0]): math.ceil(c[1] / BLOCK_ROWS) for d, cs in cells.items() for c in cs}

    def bounds(v: np.ndarray, dim: int) -> np.ndarray:
        """(queries, cells): what no member's score exceeds."""
        here = cells[dim]
        centre = by_dim.get(dim, np.zeros((1, dim)))[[c[0] for c in here]]
        norm = np.sqrt((v * v).sum(1))[:, None]
        up = np.minimum(v @ centre.T + norm * np.array([c[2] for c in here]), norm * np.array([c[3] for c in here]))
        return up + 1e-9 * (np.abs(up) + norm * np.abs(centre).max(initial=1)) + 1e-6

    def visits(first: bool):
        """(block keys, id, v, dim) of the blocks a query goes to: those of its first cell, or all others it may need."""

        def run(batches):
            for batch in batches:
                out = []
                dims = batch.column(2).to_numpy(zero_copy_only=False)
                floors = None if first else batch.column(3).to_numpy(zero_copy_only=False)
                for i, dim in enumerate(dims.tolist()):
                    if dim not in cells:
                        continue
                    v = np.array(batch.column(1)[i].as_py(), float).reshape(1, dim)
                    up, n = bounds(v, dim)[0], np.array([c[1] for c in cells[dim]])
                    home = int(np.lexsort((-up, n <= k))[0])
                    go = [home] if first else [j for j in np.flatnonzero(up >= floors[i]).tolist() if j != home]
                    out += [(i, dim, cells[dim][j][0], b) for j in go for b in range(blocks[dim, cells[dim][j][0]])]
                at, dim, cell, block = (np.array(c, np.int64) for c in (zip(*out) if out else ([],) * 4))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), *(pa.array(x.astype(np.int32)) for x in (dim, cell, block))],
                                                 names=["id", "v", "dim", "cell", "block"])

        return run

    count = F.lit(1) if not blocks else F.coalesce(F.element_at(F.create_map(*[x for (d, c), b in blocks.items() for x in (F.lit(f"{d}:{c}"), F.lit(b))]), F.concat_ws(":", "dim", "cell")), F.lit(1))
    placed = celled.select("id", "v", "dim", "cell", F.pmod(F.xxhash64("id", F.lit(5)), count).cast("int").alias("block"))
    keys = ["dim", "cell", "block"]
    kinds = "id bigint, v array<double>, dim int, cell int, block int"

    def solved(sent: DataFrame) -> DataFrame:
        return sent.groupBy(*keys).cogroup(placed.groupBy(*keys)).applyInArrow(_solver(k), "query bigint, id bigint, score bigint")

    asked = written(asked, "queries")
    near = written(_merged(solved(asked.mapInArrow(visits(True), kinds)), k), "near")
    floor = near.groupBy("query").agg(F.max(F.when(F.col("rank") == k, F.col("score"))).cast("double").alias("floor"))
    again = asked.join(floor, asked["id"] == floor["query"], "left").select("id", "v", "dim", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"))
    far = solved(again.mapInArrow(visits(False), kinds))
    return _merged(near.select("query", "id", "score").union(far), k).select(F.col("query").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias(id), "score")
