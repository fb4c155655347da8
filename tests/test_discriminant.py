"""Sparse precision matrices, and classes that lack rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import models as M, paths as P


@pytest.mark.parametrize("penalty", [0.001, 0.05, 0.4])
def test_sparse_precision_meets_its_conditions(penalty):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 8)) @ np.triu(rng.normal(size=(8, 8)) * 0.4 + np.eye(8))
    s = np.cov(x.T)
    w, prec = M.sparse_precision(s, penalty)
    assert np.allclose(w @ prec, np.eye(8), atol=1e-4) and np.linalg.eigvalsh(prec).min() > 0
    off = ~np.eye(8, dtype=bool)
    on = off & (np.abs(prec) > 1e-9)
    assert np.allclose(np.abs(w - s)[on], penalty, atol=1e-4)
    assert np.abs(w - s)[off].max() <= penalty + 1e-4 and np.allclose(np.diag(w), np.diag(s))
    if penalty == 0.4:
        assert (~on & off).sum() > 0


def cohort(spark):
    rng = np.random.default_rng(9)
    rows = []
    for k, n in (("a", 150), ("b", 100), ("c", 50)):
        x = rng.normal(size=(n, 20)) + (np.arange(20) == "abc".index(k)) * 3
        rows += [(k, *map(float, r)) for r in x]
    cols = [f"f{i}" for i in range(20)]
    return rows, cols, spark.createDataFrame(rows, "k string, " + ", ".join(f"{c} double" for c in cols))


def test_sparse_qda_equals_a_plain_one(spark):
    rows, cols, df = cohort(spark)
    got = M.discriminant(df, df, cols, "k", "qda", penalty=0.05)
    x, k = np.array([r[1:] for r in rows]), np.array([r[0] for r in rows])
    best = []
    for c in "abc":
        own = x[k == c]
        _, prec = M.sparse_precision(np.cov(own.T) + 1e-6 * np.eye(20), 0.05)
        d = x - own.mean(axis=0)
        best.append(np.log(len(own) / len(x)) + 0.5 * np.linalg.slogdet(prec)[1] - 0.5 * ((d @ prec) * d).sum(axis=1))
    best = np.array(best)
    made = {tuple(r[c] for c in cols): (r.pred, r.pred_logp) for r in got.collect()}
    for row, logp in zip(rows, best.T):
        pred, value = made[row[1:]]
        assert pred == "abc"[int(logp.argmax())] and abs(value - logp.max()) < 1e-6


@pytest.mark.parametrize("kind, width", [("lda", 3), ("qda", 3), ("lda", 20), ("qda", 20)])
def test_classes_without_rows_and_nulls(spark, kind, width):
    """A class whose rows all hold a NULL is left out; NULL features give NULL; no class at all gives NULL columns."""
    _, cols, df = cohort(spark)
    cols = cols[:width]
    holes = df.withColumn("f0", F.when(F.col("k") != "b", F.col("f0")))
    got = M.discriminant(holes, holes, cols, "k", kind)
    assert {r.pred for r in got.select("pred").distinct().collect()} == {"a", "c", None}
    assert got.filter("pred is null").count() == got.filter("pred_logp is null").count() == 100
    none = M.discriminant(holes.filter("k = 'b'"), df, cols, "k", kind)
    assert none.filter("pred is null").count() == 300 and none.columns == [*df.columns, "pred", "pred_logp"]


def test_ridge_scaled_by_variance(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 2)) * [1, 10]
    y = x @ [1.0, 0.05] + rng.normal(size=400)
    df = spark.createDataFrame([(float(a), float(b), float(v), int(i >= 300)) for i, ((a, b), v) in enumerate(zip(x, y))], "a double, b double, y double, part int")
    design, beta, history = P.ridge_tune(df, ["a", "b"], "y", "part", count=20)
    z = np.column_stack([np.ones(300), x[:300]])
    fits = [np.linalg.solve(z.T @ z / 300 + lam * np.diag([0, *x[:300].var(axis=0)]), z.T @ y[:300] / 300) for lam, _ in history]
    r2 = [1 - np.sum((y[300:] - np.column_stack([np.ones(100), x[300:]]) @ b) ** 2) / (100 * y[300:].var()) for b in fits]
    assert np.allclose([r for _, r in history], r2) and history[0][0] == 0
    falls = [k for k in range(1, len(r2)) if r2[k] < r2[k - 1]]
    assert falls in ([], [len(r2) - 1]) and np.allclose(beta, fits[-2] if falls else fits[-1])
    # units of a column do not matter
    _, other, _ = P.ridge_tune(df.withColumn("b", F.col("b") * 1000), ["a", "b"], "y", "part", count=20)
    assert np.allclose(other * [1, 1, 1000], beta)
