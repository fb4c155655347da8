"""Approximate nearest neighbours by learned partitions.

1. A bounded sample of the rows gives a neighbour graph: each sampled row and its nearest sampled rows.
2. The graph is parted into pieces of at most equal size so that few edges are cut: pieces start from recursive halving
   along the main direction, then rows move to where most of their neighbours are, best gains first, while there is room.
3. A small classifier (softmax over the components) learns from vectors the shares of pieces among a row's neighbours.
4. Every row goes to its most probable piece, every query to its most probable pieces, whose rows it is compared with. How
   many pieces is measured: bounded many rows take the place of queries, their exact neighbours among all rows are found by
   one pass over the data, and the least number is taken that finds the asked share of them.

Pieces are cut into blocks of rows and their queries into blocks too; every pair of blocks is a task's work of bounded size,
so a piece with a third of all rows is many tasks. The first piece of a query is solved first and gives a floor; other
pieces return only what reaches it.

Inner products are found by matrix products and then summed anew component by component, left to right, in double precision,
so a score does not depend on how rows meet.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import written
from .topk_join import matrix

#: Rows of a data block and queries of a query block; queries multiplied at once.
BLOCK_ROWS, BLOCK_QUERIES, AT_ONCE = 4096, 4096, 256
#: Edges of a row in the neighbour graph.
EDGES = 12


# --- the learned index ----------------------------------------------------------------------------

def neighbour_graph(v: np.ndarray, edges: int = EDGES) -> np.ndarray:
    """(rows, edges): places of the largest inner products with other rows."""
    edges = min(edges, len(v) - 1)
    out = np.empty((len(v), edges), np.int64)
    for a in range(0, len(v), 1024):
        s = v[a:a + 1024] @ v.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        out[a:a + len(s)] = np.argpartition(-s, edges - 1, axis=1)[:, :edges] if edges else 0
    return out


def balanced_parts(v: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 12) -> np.ndarray:
    """Part of each row; no part has over 1.05 times an equal share (and one)."""
    part = np.zeros(len(v), np.int64)
    halves = [(np.arange(len(v)), 0, parts)]
    while halves:  # halving along the main direction
        rows, first, n = halves.pop()
        if n == 1:
            part[rows] = first
            continue
        x = v[rows] - v[rows].mean(axis=0)
        _, axes = np.linalg.eigh(x.T @ x)
        order = rows[np.argsort(x @ axes[:, -1], kind="stable")]
        cut = len(rows) * (n // 2) // n
        halves += [(order[:cut], first, n // 2), (order[cut:], first + n // 2, n - n // 2)]
    room = math.ceil(1.05 * len(v) / parts) + 1
    ends = np.concatenate((graph.ravel(), np.repeat(np.arange(len(v)), graph.shape[1])))
    froms = np.concatenate((np.repeat(np.arange(len(v)), graph.shape[1]), graph.ravel()))
    for _ in range(rounds):
        near = np.bincount(froms * parts + part[ends], minlength=len(v) * parts).reshape(len(v), parts)
        here = near[np.arange(len(v)), part]
        to = near.argmax(axis=1)
        gain = near[np.arange(len(v)), to] - here
        size = np.bincount(part, minlength=parts)
        moved = 0
        for i in np.argsort(-gain, kind="stable").tolist():
            if gain[i] <= 0:
                break
            if size[to[i]] < room:
                size[part[i]] -= 1
                size[to[i]] += 1
                part[i] = to[i]
                moved += 1
        if not moved:
            break
    return part


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fitted(v: np.ndarray, graph: np.ndarray, part: np.ndarray, parts: int, steps: int = 150) -> tuple[np.ndarray, np.ndarray]:
    """(weights, offsets) of the classifier; its target is the shares of parts among a row and its neighbours."""
    own = np.concatenate((np.arange(len(v))[:, None], graph), axis=1)
    goal = np.bincount((np.arange(len(v))[:, None] * parts + part[own]).ravel(), minlength=len(v) * parts).reshape(len(v), parts) / own.shape[1]
    scale = 1 / max(float(np.sqrt((v * v).mean())), 1e-300)
    x = np.concatenate((v * scale, np.ones((len(v), 1))), axis=1)
    w = np.zeros((x.shape[1], parts))
    m, s = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):  # Adam on all rows
        g = x.T @ (softmax(x @ w) - goal) / len(v) + 1e-5 * w
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        w -= 0.1 * (m / (1 - 0.9 ** t)) / (np.sqrt(s / (1 - 0.99 ** t)) + 1e-9)
    return w[:-1] * scale, w[-1]


class Router:
    """Pieces in the order in which a vector may have its neighbours there."""

    def __init__(self, v: np.ndarray, parts: int):
        self.parts = parts = max(1, min(parts, len(v) // 2))
        self.w, self.b = np.zeros((v.shape[1], 1)), np.zeros(1)
        if parts > 1:
            graph = neighbour_graph(v)
            self.w, self.b = fitted(v, graph, balanced_parts(v, graph, parts), parts)

    def order(self, v: np.ndarray) -> np.ndarray:
        return np.argsort(-(v @ self.w + self.b), axis=1, kind="stable")


# --- exact scores ---------------------------------------------------------------------------------

def in_order(q: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Inner products of the rows of q and d, summed from the first component to the last."""
    total = np.zeros(len(q))
    for j in range(q.shape[1]):
        total += q[:, j] * d[:, j]
    return total


def nearest_in(q: np.ndarray, asked: np.ndarray, d: np.ndarray, ids: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the query, id, score) of the k best rows with a score of floor at least, never the query's own id; ties to the smaller id."""
    out: list[tuple[np.ndarray, ...]] = []
    size_d = float(np.sqrt((d * d).sum(axis=1)).max(initial=0))
    for a in range(0, len(q), AT_ONCE):
        part = q[a:a + AT_ONCE]
        s = part @ d.T
        s[asked[a:a + AT_ONCE, None] == ids[None, :]] = -np.inf
        slack = 1e-12 * q.shape[1] * np.sqrt((part * part).sum(axis=1)) * size_d
        kth = -np.partition(-s, k - 1, axis=1)[:, k - 1] if s.shape[1] > k else np.full(len(s), -np.inf)
        row, col = np.nonzero((s >= (np.maximum(kth, floor[a:a + AT_ONCE]) - 2 * slack)[:, None]) & (s > -np.inf))
        score = in_order(part[row], d[col])
        order = np.lexsort((ids[col], -score, row))
        row, col, score = row[order], col[order], score[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        keep = (place < k) & (score >= floor[a:a + AT_ONCE][row])
        out.append((row[keep] + a, ids[col[keep]], score[keep]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def best(found: DataFrame, k: int, spread: int = 16) -> DataFrame:
    """The k best (query, rank, id, score); in two steps, so that no task gets all of a query's rows at once."""
    order = [F.desc("score"), F.asc("id")]
    part = F.pmod(F.xxhash64("id"), F.lit(spread))
    first = found.withColumn("part", part).withColumn("r", F.row_number().over(Window.partitionBy("query", "part").orderBy(*order))).where(F.col("r") <= k)
    last = first.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order)))
    return last.where(F.col("rank") <= k).select("query", F.col("rank").cast("int").alias("rank"), "id", "score")


# --- search ---------------------------------------------------------------------------------------

def usable(vectors: DataFrame, id: str, vector: str) -> DataFrame:
    """(id, v, dim) of rows with an id whose vector is not null, not all zero and holds finite numbers only."""
    v, x = vectors[f"`{vector}`"], lambda c: c.cast("double")
    good = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(x(c)) & (F.abs(x(c)) < float("inf"))) & F.exists(v, lambda c: x(c) != 0)
    key = vectors[f"`{id}`"]
    return vectors.where(v.isNotNull() & key.isNotNull()).where(good).select(key.cast("bigint").alias("id"), F.transform(v, x).alias("v"), F.size(v).alias("dim"))


def _rows_by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places, vectors) for each length of the batch's (id, v, dim, ...)."""
    dims = batch.column(batch.schema.get_field_index("dim")).to_numpy(zero_copy_only=False)
    v = batch.column(batch.schema.get_field_index("v"))
    for dim in np.unique(dims):
        at = np.flatnonzero(dims == dim)
        yield int(dim), at, matrix(v.take(pa.array(at)), int(dim))


def _routed(routers: dict[int, Router], most: dict[int, int], extra: list[str]):
    """For mapInArrow: (id, v, dim, extra, part, turn): a row for each of the first most[dim] pieces."""

    def run(batches):
        for batch in batches:
            for dim, at, v in _rows_by_dim(batch):
                go = routers[dim].order(v)[:, :most[dim]] if dim in routers else np.zeros((len(at), 1), np.int64)
                rows = batch.take(pa.array(np.repeat(at, go.shape[1])))
                yield pa.RecordBatch.from_arrays([*(rows.column(rows.schema.get_field_index(c)) for c in ["id", "v", "dim", *extra]), pa.array(go.ravel().astype(np.int32)),
                                                  pa.array(np.tile(np.arange(go.shape[1], dtype=np.int32), len(at)))], names=["id", "v", "dim", *extra, "part", "turn"])

    return run


FOUND = pa.schema([("query", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])


def _solver(k: int):
    def solve(queries: pa.Table, data: pa.Table) -> pa.Table:
        if not len(queries) or not len(data):
            return FOUND.empty_table()
        dim = data["dim"][0].as_py()
        asked = queries["id"].to_numpy()
        floor = queries["floor"].to_numpy()
        at, ids, score = nearest_in(matrix(queries["v"], dim), asked, matrix(data["v"], dim), data["id"].to_numpy(), k, floor)
        return pa.table([asked[at], ids, score], schema=FOUND)

    return solve


def _exact(probes: dict[int, tuple[np.ndarray, np.ndarray]], routers: dict[int, Router], k: int):
    """For mapInArrow over all rows: each task's k best rows for each probe, with the turn at which the probe would visit the row's piece."""

    def run(batches):
        held: dict[int, tuple[np.ndarray, ...]] = {}
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for dim, at, v in _rows_by_dim(batch):
                if dim not in probes:
                    continue
                asked, q = probes[dim]
                row, near, score = nearest_in(q, asked, v, ids[at], k, np.full(len(q), -np.inf))
                order = np.argsort(ids[at], kind="stable")
                place = order[np.searchsorted(ids[at][order], near)]
                piece = routers[dim].order(v[place])[:, 0]
                turn = np.argsort(routers[dim].order(q), axis=1)[row, piece]
                new = row, near, score, turn
                if dim in held:
                    new = tuple(np.concatenate(x) for x in zip(held[dim], new))
                keep = np.lexsort((new[1], -new[2], new[0]))
                new = tuple(x[keep] for x in new)
                first = np.arange(len(keep)) - np.searchsorted(new[0], new[0]) < k
                held[dim] = tuple(x[first] for x in new)
        for dim, (row, near, score, turn) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(probes[dim][0][row]), pa.array(near), pa.array(score), pa.array(turn.astype(np.int32)), pa.array(np.full(len(row), dim, np.int32))],
                                             names=["query", "id", "score", "turn", "dim"])

    return run


def _sampled(data: DataFrame, rows: int, seed: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """{length: (ids, vectors)} of at most ``rows`` rows, the same for every run."""
    got = data.select("id", "v", "dim", F.xxhash64("id", "v", F.lit(seed)).alias("h")).orderBy("h", "id").limit(rows).collect()
    out: dict[int, tuple[list, list]] = {}
    for r in got:
        out.setdefault(r["dim"], ([], []))[0].append(r["id"])
        out[r["dim"]][1].append(r["v"])
    return {d: (np.array(i, np.int64), np.array(v, float).reshape(len(v), d)) for d, (i, v) in out.items()}


def _counted(df: DataFrame, size: int) -> Column:
    """Blocks of a (dim, part) of ``df``: its rows over ``size``, as a lookup of a bounded number of pieces."""
    rows = df.groupBy("dim", "part").count().collect()  # one row for each piece
    found = [x for r in rows for x in (F.lit(f"{r['dim']}:{r['part']}"), F.lit(-(-r["count"] // size)))]
    return F.coalesce(F.element_at(F.create_map(*found), F.concat_ws(":", "dim", "part")), F.lit(1)) if found else F.lit(1)


def neighbours(vectors: DataFrame, queries: DataFrame, k: int = 20, id: str = "vec_id", vector: str = "embedding", sample: int = 8192,
               probes: int = 384, recall: float = 0.95, pieces: int | None = None, report: dict | None = None) -> DataFrame:
    """(query_id, rank, <id>, score): for each query k rows of another id with the largest inner products found. Runs jobs.

    The index is fitted on at most ``sample`` rows and every row is in it. ``pieces`` defaults to the square root of twice the
    rows, 128 at most (64 sampled rows for each). ``probes`` rows measure how many pieces a query visits so that the share
    ``recall`` of their exact neighbours is found; ``report``, if given, receives pieces, visits and that share by length.

    Vectors null, zero, or holding null or non-finite components, and null ids, take no part. Vectors meet only those of their
    length; lengths that the sample lacks are one piece. Ties go to the smaller id; fewer than k candidates in the visited
    pieces make fewer rows, if the table has more, all pieces are visited. A repeated candidate row counts each time, a
    repeated query id answers once, for its smallest vector. An empty table gives no rows. Other columns are not read.
    """
    data = written(usable(vectors, id, vector).withColumn("n", F.monotonically_increasing_id()), "vectors")
    once = usable(queries, id, vector).groupBy("id").agg(F.min(F.struct("v", "dim")).alias("x")).select("id", "x.*")
    asked = written(once.withColumn("n", F.monotonically_increasing_id()), "queries")
    total = data.count()
    drawn = _sampled(data, sample, 13)
    parts = pieces or max(1, min(128, sample // 64, round(math.sqrt(2 * total) / 2)))
    routers = {d: Router(v, round(parts * len(v) / min(sample, max(total, 1)))) for d, (_, v) in drawn.items() if d}
    tried = {d: x for d, x in _sampled(data, probes, 29).items() if d in routers}
    exact = data.select("id", "v", "dim").mapInArrow(_exact(tried, routers, k), "query bigint, id bigint, score double, turn int, dim int")
    order = Window.partitionBy("query", "dim").orderBy(F.desc("score"), F.asc("id"))
    turns = exact.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).groupBy("dim", "turn").count().collect()
    most = {}
    for d, router in routers.items():
        hits = np.zeros(router.parts)
        for r in turns:
            if r["dim"] == d:
                hits[r["turn"]] = r["count"]
        share = np.cumsum(hits) / max(hits.sum(), 1)
        most[d] = int(np.searchsorted(share, recall)) + 1 if hits.sum() else router.parts
        most[d] = min(most[d], router.parts)
        if report is not None:
            report[d] = {"pieces": router.parts, "visits": most[d], "recall": float(share[most[d] - 1])}

    placed = written(data.mapInArrow(_routed(routers, {d: 1 for d in routers}, ["n"]), "id bigint, v array<double>, dim int, n bigint, part int, turn int"), "placed")
    sent = written(asked.mapInArrow(_routed(routers, most, ["n"]), "id bigint, v array<double>, dim int, n bigint, part int, turn int"), "sent")
    blocks, chunks = _counted(placed, BLOCK_ROWS), _counted(sent, BLOCK_QUERIES)
    spread = lambda n, seed: F.pmod(F.xxhash64("n", F.lit(seed)), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), n.cast("int") - 1))
    keys = ["dim", "part", "block", "chunk"]
    there = placed.select("id", "v", "dim", "part", spread(blocks, 5).alias("block"), each(chunks).alias("chunk"))

    def solved(some: DataFrame) -> DataFrame:
        here = some.select("id", "v", "dim", "part", "floor", spread(chunks, 7).alias("chunk"), each(blocks).alias("block"))
        renamed = there.select("id", "v", "dim", *[F.col(c).alias(f"of_{c}") for c in keys])
        return here.groupBy(*keys).cogroup(renamed.groupBy(*[f"of_{c}" for c in keys])).applyInArrow(_solver(k), "query bigint, id bigint, score double")

    near = written(best(solved(sent.where("turn = 0").withColumn("floor", F.lit(float("-inf")))), k), "near")
    floor = near.groupBy("query").agg(F.max(F.when(F.col("rank") == k, F.col("score"))).alias("f"))
    rest = sent.where("turn > 0").join(floor, F.col("id") == F.col("query"), "left").select("id", "v", "dim", "part", "n", F.coalesce("f", F.lit(float("-inf"))).alias("floor"))
    found = written(best(near.select("query", "id", "score").unionByName(solved(rest)), k), "found")
    # queries whose visited pieces hold fewer than k rows visit all others
    short = asked.join(found.groupBy("query").count().where(F.col("count") >= k), F.col("id") == F.col("query"), "left_anti")
    wide = short.mapInArrow(_routed(routers, {d: r.parts for d, r in routers.items()}, ["n"]), "id bigint, v array<double>, dim int, n bigint, part int, turn int")
    seen = F.coalesce(F.create_map(*[F.lit(x) for d, m in most.items() for x in (d, m)])[F.col("dim")], F.lit(1)) if most else F.lit(1)
    more = solved(wide.where(F.col("turn") >= seen).withColumn("floor", F.lit(float("-inf"))))
    last = best(found.select("query", "id", "score").unionByName(more), k)
    return last.select(F.col("query").alias("query_id"), "rank", F.col("id").alias(id), "score")
