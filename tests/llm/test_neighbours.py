"""Learned partitions against a full search."""

import numpy as np
import pytest

from cohortlens.llm import neighbours as nb


def searched(ids, v, asked, k):
    out = {}
    for q in asked:
        s = nb.in_order(np.repeat(v[ids == q][:1], len(v), axis=0), v)
        order = [i for i in np.lexsort((ids, -s)).tolist() if ids[i] != q][:k]
        out[q] = [(int(ids[i]), float(s[i])) for i in order]
    return out


def by_query(df):
    out = {}
    for r in sorted(df.collect()):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def clustered(n, seed, dim=16, groups=40):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(groups, dim)) * 3
    return centre[rng.integers(groups, size=n)] + rng.normal(size=(n, dim)) * 0.4


def test_clustered_vectors_visit_few_pieces(spark, monkeypatch):
    monkeypatch.setattr(nb, "BLOCK_ROWS", 100)
    v = clustered(3000, 1)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    ids = np.arange(3000)
    df = spark.createDataFrame([(int(i), x.tolist(), "x") for i, x in zip(ids, v)], "vec_id long, embedding array<double>, part string")
    report = {}
    got = by_query(nb.neighbours(df, df.where("vec_id % 20 = 0"), k=10, sample=1024, probes=128, report=report))
    want = searched(ids, v, range(0, 3000, 20), 10)
    assert got.keys() == want.keys() and all(len(x) == 10 for x in got.values())
    share = np.mean([len(set(got[q]) & set(want[q])) / 10 for q in want])
    assert share >= 0.93 and report[16]["visits"] <= 0.3 * report[16]["pieces"]


def test_given_table_reaches_recall(spark):
    import pyarrow.parquet as pq

    path = "/root/testdata/sf0.01/embeddings.parquet"
    rows = pq.read_table(path).to_pydict()
    ids, v = np.array(rows["vec_id"]), np.array(rows["embedding"], np.float64)
    df = spark.read.parquet(path)
    got = by_query(nb.neighbours(df, df.where("vec_id % 20 = 0")))
    want = searched(ids, v, [i for i in ids.tolist() if i % 20 == 0], 20)
    assert got.keys() == want.keys()
    assert np.mean([len(set(got[q]) & set(want[q])) / 20 for q in want]) >= 0.9


def test_odd_rows(spark):
    """Nulls, zeros, other lengths, ties, repeated rows, clashing names, empty tables."""
    rows = [(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (None, [1.0, 1.0]), (6, [1.0, 2.0, 3.0]),
            (20, [2.0, 1.0]), (21, [2.0, 1.0]), (21, [2.0, 1.0]), (9, [2.0, 1.0]), (40, [1.0, 1.0, 1.0]), (60, []), (80, [-1.0, 0.5])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, score string, query long")
    got = by_query(nb.neighbours(df, df.where("vec_id % 20 = 0"), k=3, recall=1.0))
    assert got == {0: [(9, 2.0), (20, 2.0), (21, 2.0)], 20: [(9, 5.0), (21, 5.0), (21, 5.0)], 40: [(6, 6.0)], 80: [(0, -1.0), (9, -1.5), (20, -1.5)]}
    assert nb.neighbours(df.limit(0), df.limit(0)).count() == 0
    assert nb.neighbours(df, df.limit(0)).count() == 0


def test_parts_are_balanced():
    v = clustered(1000, 3)
    graph = nb.neighbour_graph(v)
    part = nb.balanced_parts(v, graph, 8)
    assert np.bincount(part, minlength=8).max() <= 1.05 * 125 + 2
    cut = np.mean(part[graph] != part[:, None])
    assert cut < 0.5
    router = nb.Router(v, 8)
    assert np.mean(router.order(v)[:, 0] == np.argmax(v @ router.w + router.b, axis=1)) == 1


def test_many_equal_vectors(spark, monkeypatch):
    monkeypatch.setattr(nb, "BLOCK_ROWS", 50)
    monkeypatch.setattr(nb, "BLOCK_QUERIES", 4)
    v = np.concatenate((np.tile([[0.6, 0.8]], (400, 1)), clustered(200, 5, dim=2)))
    ids = np.arange(600)
    df = spark.createDataFrame([(int(i), x.tolist()) for i, x in zip(ids, v)], "vec_id long, embedding array<double>")
    got = by_query(nb.neighbours(df, df.where("vec_id % 20 = 0"), k=5, recall=1.0, pieces=4))
    want = searched(ids, v, range(0, 600, 20), 5)
    assert np.mean([len(set(got[q]) & set(want[q])) / 5 for q in want]) >= 0.99
    assert all([s for _, s in got[q]] == sorted([s for _, s in got[q]], reverse=True) for q in got)


@pytest.mark.parametrize("k", [1, 4])
def test_floor_keeps_ties(k):
    q, d = np.array([[1.0, 0.0]]), np.array([[1.0, 5.0], [1.0, 2.0], [0.5, 0.0]])
    at, ids, score = nb.nearest_in(q, np.array([9]), d, np.array([7, 3, 5]), k, np.array([1.0]))
    assert list(zip(ids.tolist(), score.tolist())) == [(3, 1.0), (7, 1.0)][:k]
