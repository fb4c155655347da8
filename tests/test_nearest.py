"""The nearest reference row against a full search: dense tables, many dimensions, NULLs on both sides, small leaves."""

import math
import random

import numpy as np
import pytest

from cohortlens.operators import nearest as N


def searched(queries, reference, dims):
    bad = lambda v: any(x is None or math.isnan(x) for x in v)
    good = [r for r in reference if r[0] is not None and not bad(r[1:1 + dims])]
    out = []
    for q in queries:
        if q[0] is None:
            continue
        best = None if bad(q[1:1 + dims]) else min(((round(sum(abs(x - y) for x, y in zip(q[1:1 + dims], r[1:1 + dims])), 9), r[0]) for r in good), default=None)
        out.append((q[0], best[1] if best else None, best[0] if best else None))
    return sorted(out, key=str)


def found(df, q, r):
    return sorted(((row[q], row[r], row["err"]) for row in df.collect()), key=str)


@pytest.fixture
def small(monkeypatch):
    for name, value in (("LEAF", 20), ("BLOCK", 16), ("CHUNK", 8), ("AT_ONCE", 5), ("SAMPLE", 300)):
        monkeypatch.setattr(N, name, value)


COLS = [f"c{i}" for i in range(6)]


def tables(spark, n=1500, m=60, step=None, seed=1):
    rng = random.Random(seed)
    value = lambda: rng.randrange(step) / step if step else rng.random()
    ref = [(i, *(value() for _ in COLS)) for i in range(n)]
    qry = [(i, *(value() for _ in COLS)) for i in range(m)]
    kinds = ", ".join(f"{c} double" for c in COLS)
    return qry, ref, spark.createDataFrame(qry, f"q long, {kinds}"), spark.createDataFrame(ref, f"r long, {kinds}")


@pytest.mark.parametrize("step", [None, 4])
def test_dense_table_in_small_leaves(spark, small, step):
    """Many leaves, blocks and rounds; with a coarse grid many rows are equally near and the smallest id wins."""
    qry, ref, q, r = tables(spark, step=step)
    assert found(N.nearest(q, r, COLS, [], "q", "r"), "q", "r") == [(a, b, pytest.approx(c, abs=2e-9)) for a, b, c in searched(qry, ref, 6)]


def test_leaves_are_visited_by_bound(spark, small):
    """On clustered points most queries need few leaves."""
    points = np.random.default_rng(1).normal(size=(4000, 2)) * 0.01 + np.random.default_rng(2).integers(0, 20, (4000, 2))
    nodes = N.split_tree(points, 64)
    leaf = N.leaf_of(nodes, points)
    sizes = np.bincount(leaf)
    assert len(sizes) >= 60 and sizes.max() <= 3 * 4000 / 64
    assert len(N.split_tree(np.ones((50, 3)), 8)) == 1  # equal points are one leaf


def test_nulls_on_both_sides(spark):
    nan = float("nan")
    qry = [(1, 1e9, 1e9), (2, None, 3.0), (3, 0.0, nan), (4, 5.0, 6.0), (4, 100.0, 100.0), (None, 1.0, 1.0), (5, -0.0, 0.0)]
    ref = [(1, 5.0, 6.0), (2, None, 3.0), (3, 1.2e9, 1e9), (4, nan, 0.0), (None, 1e9, 1e9), (9, 0.0, -0.0), (8, 0.0, 0.0)]
    q, r = spark.createDataFrame(qry, "q long, a double, b double"), spark.createDataFrame(ref, "r long, a double, b double")
    got = found(N.nearest(q, r, ["a", "b"], [], "q", "r"), "q", "r")
    assert got == searched(qry, ref, 2)
    assert (2, None, None) in got and (1, 3, 2e8) in got and (5, 8, 0.0) in got
    # no reference left, no queries
    assert found(N.nearest(q, r.filter("r = 2"), ["a", "b"], [], "q", "r"), "q", "r") == sorted([(a, None, None) for a, *_ in qry if a is not None], key=str)
    assert N.nearest(q.limit(0), r, ["a", "b"], [], "q", "r").count() == 0


def test_text_ids_and_categories(spark):
    q = spark.createDataFrame([("x", 1.0, "u", "v"), ("y", 9.0, None, "v")], "id string, a double, k string, l string")
    r = spark.createDataFrame([("b", 2.0, "u", "v"), ("a", 0.0, "u", "w"), ("c", 9.5, None, "v")], "rid string, a double, k string, l string")
    got = {row.id: (row.rid, row.err, row.prop) for row in N.nearest(q, r, ["a"], ["k", "l"], "id", "rid").collect()}
    assert got == {"x": ("a", 1.0, 0.5), "y": ("c", 0.5, 0.5)}
