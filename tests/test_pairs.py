"""Draws spread over tasks; pairs of each scope; concordance fits against plain sums over pairs."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import draws as D, joins as J, pairs as C, ranking as R


def test_one_keys_draws_are_many_tasks(spark):
    sizes = spark.createDataFrame([("hot", 2_000_000), ("small", 3), ("none", 0), ("null", None)], "k string, n long")
    got = D.spread_draws(sizes, ["k"], F.col("n"), chunk=10_000)
    by_task = got.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(by_task) >= 4 and max(r["count"] for r in by_task) < 0.6 * 2_000_003
    found = {r.k: (r.n, r.a, r.b, r.d) for r in got.groupBy("k").agg(F.count("*").alias("n"), F.min("i").alias("a"), F.max("i").alias("b"), F.countDistinct("i").alias("d")).collect()}
    assert found == {"hot": (2_000_000, 1, 2_000_000, 2_000_000), "small": (3, 1, 3, 3)}


def test_draws_do_not_depend_on_chunks_or_partitions(spark, monkeypatch):
    df = spark.createDataFrame([(i, "ab"[i % 2], i % 3 == 0, float(i % 17)) for i in range(200)], "id long, g string, y boolean, score double").withColumn("y", F.col("y").cast("int"))
    first = sorted(map(tuple, J.sample_pairs(df, ["g"], 500, 7, "id").collect()))
    auc = R.sampled_pair_auc(df, ["g"], 500, 7, "id").orderBy("g").collect()
    monkeypatch.setattr(D, "CHUNK", 7)
    assert sorted(map(tuple, J.sample_pairs(df.repartition(9), ["g"], 500, 7, "id").collect())) == first
    assert R.sampled_pair_auc(df.coalesce(1), ["g"], 500, 7, "id").orderBy("g").collect() == auc


def cohort(spark, n=90, seed=2):
    rng = np.random.default_rng(seed)
    rows = [(i, str(rng.choice(["a", "b", "c", "d"], p=[0.5, 0.3, 0.15, 0.05])), float(rng.normal()), float(rng.normal()), 0) for i in range(n)]
    rows = [(i, g, x, z, int(rng.uniform() < 1 / (1 + np.exp(-x + 0.5 * z - (g == "a"))))) for i, g, x, z, _ in rows]
    return rows, spark.createDataFrame(rows, "id long, g string, x double, z double, y int").withColumn("off", F.when(F.col("g") == "a", 0.4).otherwise(-0.2))


def pairs_of(rows, scope):
    return [(a, b) for a in rows for b in rows if a[4] == 1 and b[4] == 0 and (scope == "total" or (a[1] == b[1]) == (scope == "within"))]


@pytest.mark.parametrize("scope", ["total", "within", "between"])
def test_all_pairs_where_they_are_few(spark, scope):
    rows, df = cohort(spark)
    got = C.concordance_pairs(df, scope, "g", "id", ["x", "z"], offset="off").collect()
    want = Counter((round(a[2] - b[2], 9), round(a[3] - b[3], 9)) for a, b in pairs_of(rows, scope))
    assert Counter((round(r.x[0], 9), round(r.x[1], 9)) for r in got) == want and all(r.weight == 1 for r in got)


@pytest.mark.parametrize("scope", ["total", "within", "between"])
def test_draws_where_they_are_many(spark, scope):
    """Drawn pairs are pairs of the scope; weighed, they stand for all of them; a set below the limit stays whole."""
    rows, df = cohort(spark)
    possible = {(round(a[2] - b[2], 9), round(a[3] - b[3], 9)) for a, b in pairs_of(rows, scope)}
    got = C.concordance_pairs(df, scope, "g", "id", ["x", "z"], most=40, weigh=True).collect()
    assert {(round(r.x[0], 9), round(r.x[1], 9)) for r in got} <= possible
    assert sum(r.weight for r in got) == pytest.approx(len(pairs_of(rows, scope)))
    again = C.concordance_pairs(df.repartition(5), scope, "g", "id", ["x", "z"], most=40, weigh=True).collect()
    assert sorted((r.x, r.weight) for r in got) == sorted((r.x, r.weight) for r in again)


def test_fit_is_the_optimum(spark):
    rows, df = cohort(spark)
    offset = {"a": 0.4}
    d = np.array([[a[2] - b[2], a[3] - b[3]] for a, b in pairs_of(rows, "total")])
    off = np.array([offset.get(a[1], -0.2) - offset.get(b[1], -0.2) for a, b in pairs_of(rows, "total")])
    lambdas = [0.1, 50.0, 1e4]
    w = C.fit_pairs(C.concordance_pairs(df, "total", "g", "id", ["x", "z"], offset="off"), 2, lambdas)
    for lam, b in zip(lambdas, w):
        q = 1 / (1 + np.exp(d @ b + off))
        assert np.abs(d.T @ q - lam * b).max() < 1e-6
    best, history = C.concordance_fit(df, df, "within", "g", "id", ["x", "z"], lambdas)
    assert len(history) == 3 and best[0] > 0 > best[1]
    # inside a group the offset cancels, between groups it is left out
    assert np.allclose(best, C.concordance_fit(df, df, "within", "g", "id", ["x", "z"], lambdas, offset="off")[0])


def test_odd_rows(spark):
    rows, df = cohort(spark, 40)
    holes = df.withColumn("x", F.when(F.col("id") % 5 != 0, F.col("x"))).withColumn("y", F.when(F.col("id") % 7 != 0, F.col("y"))).withColumn("g", F.when(F.col("id") % 11 != 0, F.col("g")))
    kept = [r for r in rows if r[0] % 5 and r[0] % 7 and r[0] % 11]
    for scope in ("total", "within", "between"):
        assert C.concordance_pairs(holes, scope, "g", "id", ["x"]).count() == len(pairs_of(kept, scope))
        assert C.concordance_pairs(holes.limit(0), scope, "g", "id", ["x"]).count() == 0
    assert C.fit_pairs(C.concordance_pairs(holes.filter("y = 1"), "total", "g", "id", ["x"]), 1, [1.0]).tolist() == [[0.0]]


def test_group_offset(spark):
    train = spark.createDataFrame([("a", 1), ("a", 1), ("a", 0), ("b", 0), ("b", 0), ("b", 1), (None, 1)], "g string, y int")
    got = {r.g: r.offset for r in C.group_offset(train, spark.createDataFrame([("a",), ("b",), ("new",), (None,)], "g string"), "g").collect()}
    p = {("a", 1): 3 / 6, ("a", 0): 2 / 5, ("b", 1): 2 / 6, ("b", 0): 3 / 5}
    base = np.log(4 / 3) + sum(np.log(1 - p[g, 1]) - np.log(1 - p[g, 0]) for g in "ab")
    logit = lambda v: np.log(v / (1 - v))
    assert got["new"] == pytest.approx(base) == got[None]
    assert got["a"] == pytest.approx(base + logit(p["a", 1]) - logit(p["a", 0]))
