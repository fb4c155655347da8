"""Exact nearest reference row by summed absolute difference (C13, N2, N3), over all numeric columns.

1. Equal reference vectors are one point. A bounded sample of the points gives a k-d tree, split along the widest column at
   the median until a leaf stands for about LEAF points. Every point goes to its leaf; one aggregation gives each leaf's box
   (least and greatest value of each column). Boxes are as many as leaves, which the sample bounds.
2. No point of a leaf is closer to a query than the leaf's box. A query visits leaves in the order of that bound, in rounds of
   1, 8 and all others, as long as the bound is below its best distance so far.
3. Leaves are cut into blocks and their queries into chunks of bounded size; a (leaf, block, chunk) is solved in one place, so
   neither a leaf that the sample misjudged nor a leaf that all queries visit grows a task.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage

#: Points that a leaf stands for, rows of a block, queries of a chunk, queries compared at once.
LEAF, BLOCK, CHUNK, AT_ONCE = 4096, 8192, 4096, 128
#: Points sampled for the tree; leaves are an eighth of it at most.
SAMPLE = 16_384
#: Leaves that a query may visit by the end of each round but the last.
ROUNDS = (1, 9)
#: Distances are told apart to nine digits.
SLACK = 1.1e-9


def split_tree(points: np.ndarray, leaves: int) -> list[tuple[int, float, int, int]]:
    """Nodes (column, value, node of those up to it, node of those above); column -1 is a leaf, whose value is its number."""
    nodes: list = [None]
    work = [(0, points, leaves)]
    count = 0
    while work:
        at, own, n = work.pop()
        spread = own.max(axis=0) - own.min(axis=0) if len(own) else np.zeros(points.shape[1])
        j = int(spread.argmax()) if len(spread) else 0
        if n < 2 or len(own) < 2 or not spread[j] > 0:
            nodes[at] = (-1, float(count), 0, 0)
            count += 1
            continue
        value = float(np.quantile(own[:, j], (n // 2) / n, method="lower"))
        if value == own[:, j].max():  # all above half are equal: cut below them
            value = float(own[own[:, j] < value, j].max())
        low = own[:, j] <= value
        nodes[at] = (j, value, len(nodes), len(nodes) + 1)
        work += [(len(nodes), own[low], n // 2), (len(nodes) + 1, own[~low], n - n // 2)]
        nodes += [None, None]
    return nodes


def leaf_of(nodes: list, v: np.ndarray) -> np.ndarray:
    """Leaf number of each row."""
    at = np.zeros(len(v), np.int64)
    column, value, left, right = (np.array(x) for x in zip(*nodes))
    while True:
        go = np.flatnonzero(column[at] >= 0)
        if not len(go):
            return value[at].astype(np.int64)
        here = at[go]
        at[go] = np.where(v[go, column[here]] <= value[here], left[here], right[here])


def _matrix(col: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return np.asarray(col.flatten().to_numpy(zero_copy_only=False), float).reshape(len(col), dims)


def _vector(df: DataFrame, cols: list[str]) -> Column:
    return F.array(*[F.col(f"`{c}`").cast("double") for c in cols])


def nearest(queries: DataFrame, reference: DataFrame, num_cols: list[str], cat_cols: list[str], qid: str, rid: str) -> DataFrame:
    """qid, rid, err (nine digits), prop (share of equal ``cat_cols``, where there are any): for each query row the reference row with the least sum of absolute
    differences over ``num_cols``; ties: smallest rid. Runs jobs.

    Reference rows with a NULL or NaN among ``num_cols`` or without a rid take no part. A query with one, or with no
    reference left, keeps its row with NULL rid and err. A repeated query id answers for each of its rows; rows without one are
    left out. prop counts a category that is NULL on either side as different.
    """
    dims = len(num_cols)
    complete = lambda c: F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v))
    points = reference.select(F.col(f"`{rid}`").alias("rid"), _vector(reference, num_cols).alias("v")).filter(F.col("rid").isNotNull() & complete(F.col("v")))
    points = points.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))  # -0.0 is 0.0
    points = cut_lineage(points.groupBy("v").agg(F.min("rid").alias("rid")).withColumn("n", F.monotonically_increasing_id()))
    asked = cut_lineage(queries.filter(F.col(f"`{qid}`").isNotNull()).select(F.col(f"`{qid}`").alias("qid"), _vector(queries, num_cols).alias("v")).distinct()
                        .withColumn("q", F.monotonically_increasing_id()))
    total = points.count()
    drawn = points.select("v", F.xxhash64("v").alias("h")).orderBy("h").limit(SAMPLE).collect()
    sample = np.array([r["v"] for r in drawn], float).reshape(len(drawn), dims)
    nodes = split_tree(sample, max(1, min(-(-total // LEAF), len(sample) // 8)))
    rid_kind = reference.schema[rid].dataType.simpleString()

    def place(batches):
        for batch in batches:
            leaf = leaf_of(nodes, _matrix(batch.column(0), dims))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf.astype(np.int32))], names=["v", "rid", "n", "leaf"])

    placed = cut_lineage(points.select("v", "rid", "n").mapInArrow(place, f"v array<double>, rid {rid_kind}, n bigint, leaf int"))
    boxes = placed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), *[f(F.col("v")[i]).alias(f"{k}{i}") for i in range(dims) for k, f in (("a", F.min), ("b", F.max))])
    boxes = sorted(boxes.collect())
    leaves = np.array([r["leaf"] for r in boxes], np.int32)
    low, high = (np.array([[r[f"{k}{i}"] for i in range(dims)] for r in boxes], float).reshape(len(boxes), dims) for k in "ab")

    def by_number(sizes: list[tuple[int, int]], size: int) -> Column:
        more = [x for leaf, n in sizes if n > size for x in (F.lit(int(leaf)), F.lit(-(-n // size)))]
        return F.coalesce(F.try_element_at(F.create_map(*more), F.col("leaf")), F.lit(1)) if more else F.lit(1)

    blocks = by_number([(r["leaf"], r["n"]) for r in boxes], BLOCK)
    there = placed.select(F.col("v").alias("rv"), "rid", F.col("leaf"), F.pmod(F.xxhash64("n"), blocks).cast("int").alias("block"))

    def visits(first: int, last: int | None):
        """For mapInArrow on (q, v, u): the leaves in places first .. last of the query's order whose bound is below u."""
        def run(batches):
            for batch in batches:
                v, u = _matrix(batch.column(1), dims), batch.column(2).to_numpy(zero_copy_only=False)
                for a in range(0, len(v), AT_ONCE):
                    part = v[a:a + AT_ONCE]
                    bound = np.zeros((len(part), len(leaves)))
                    for j in range(dims):
                        bound += np.maximum(np.maximum(low[None, :, j] - part[:, None, j], part[:, None, j] - high[None, :, j]), 0)
                    order = np.argsort(bound, axis=1, kind="stable")[:, first:last]
                    near = np.take_along_axis(bound, order, axis=1) <= (u[a:a + AT_ONCE] * (1 + 1e-12) + SLACK)[:, None]
                    row, col = np.nonzero(near)
                    rows = batch.slice(a, len(part)).take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), rows.column(2), pa.array(leaves[order[row, col]])], names=["q", "v", "u", "leaf"])

        return run

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        out_q, out_d, out_at = [], [], []
        if len(left) and len(right):
            q, u, d = _matrix(left["v"], dims), left["u"].to_numpy(), _matrix(right["rv"], dims)
            for a in range(0, len(q), AT_ONCE):
                part = q[a:a + AT_ONCE]
                far = np.zeros((len(part), len(d)))
                for j in range(dims):
                    far += np.abs(part[:, None, j] - d[None, :, j])
                row, col = np.nonzero(far <= np.minimum(far.min(axis=1), u[a:a + AT_ONCE])[:, None] + SLACK)
                out_q.append(left["q"].to_numpy()[a:a + AT_ONCE][row])
                out_d.append(far[row, col])
                out_at.append(col)
        ids = right["rid"].combine_chunks() if len(right) else pa.array([], rid_type)
        at = np.concatenate(out_at) if out_at else np.zeros(0, np.int64)
        ids = ids.take(pa.array(at))
        found = pa.table([pa.array(np.concatenate(out_q) if out_q else np.zeros(0, np.int64)), pa.array(np.concatenate(out_d) if out_d else np.zeros(0)), ids], names=["q", "d", "rid"])
        least = found.group_by(["q", "d"]).aggregate([("rid", "min")])  # of points equally far the smallest rid
        return least.select(["q", "d", "rid_min"]).rename_columns(["q", "d", "rid"])

    rid_type = pa.int64() if rid_kind == "bigint" else pa.int32() if rid_kind == "int" else pa.string() if rid_kind == "string" else None
    if rid_type is None:
        raise TypeError(f"{rid}: {rid_kind}; bigint, int or string")
    best = None
    open_ = asked.filter(complete(F.col("v")))
    ends = [*ROUNDS, None] if len(leaves) > ROUNDS[-1] else [ROUNDS[0], None] if len(leaves) > 1 else [None]
    start = 0
    for end in ends if len(leaves) else []:
        bounded = open_.select("q", "v", F.lit(float("inf")).alias("u")) if best is None else open_.join(best.select("q", F.col("b.err").alias("u")), "q").select("q", "v", "u")
        sent = cut_lineage(bounded.mapInArrow(visits(start, end), "q bigint, v array<double>, u double, leaf int"))
        counts = sent.groupBy("leaf").count().collect()  # one row for each leaf
        chunks = by_number([tuple(r) for r in counts], CHUNK)
        each = lambda n: F.explode(F.sequence(F.lit(0), n.cast("int") - 1))
        here = sent.select("q", "v", "u", F.col("leaf").alias("l"), F.pmod(F.xxhash64("q"), chunks).cast("int").alias("c"), each(blocks).alias("b"))
        data = there.select("rv", "rid", "leaf", "block", each(chunks).alias("chunk"))
        made = here.groupBy("l", "b", "c").cogroup(data.groupBy("leaf", "block", "chunk")).applyInArrow(solve, f"q bigint, d double, rid {rid_kind}")
        found = made.select("q", F.struct(F.round("d", 9).alias("err"), "rid").alias("b"))
        found = found if best is None else found.unionByName(best)
        best = cut_lineage(found.groupBy("q").agg(F.min("b").alias("b")))
        start = end
    if best is None:
        best = asked.limit(0).select("q", F.struct(F.lit(0.0).alias("err"), F.lit(None).cast(rid_kind).alias("rid")).alias("b"))
    hits = asked.join(best, "q", "left").select(F.col("qid").alias(qid), F.col("b.rid").alias(rid), F.col("b.err").alias("err"), F.col("v").alias("_v"))
    # back to the query rows, repeated ones too
    rows = queries.filter(F.col(f"`{qid}`").isNotNull()).select(F.col(f"`{qid}`").alias(qid), _vector(queries, num_cols).alias("_v"), *[F.col(f"`{c}`").alias(f"_q_{c}") for c in cat_cols])
    same_v = F.col("a._v").eqNullSafe(F.col("h._v"))
    out = rows.alias("a").join(hits.alias("h"), (F.col(f"a.{qid}") == F.col(f"h.{qid}")) & same_v).select(F.col(f"a.{qid}"), F.col(f"h.{rid}"), F.col("h.err"), *[F.col(f"a._q_{c}") for c in cat_cols])
    if not cat_cols:
        return out
    r = reference.select(F.col(f"`{rid}`").alias("_rid"), *[F.col(f"`{c}`").alias(f"_r_{c}") for c in cat_cols]).dropDuplicates(["_rid"])
    same = reduce(lambda x, y: x + y, [F.coalesce((F.col(f"_q_{c}") == F.col(f"_r_{c}")).cast("int"), F.lit(0)) for c in cat_cols])
    return (out.join(r, F.col(rid) == F.col("_rid"), "left")
            .select(qid, rid, "err", F.when(F.col(rid).isNotNull(), same / F.lit(float(len(cat_cols)))).alias("prop")))
