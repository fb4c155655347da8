"""One model per group: against plain Newton fits, small and large groups alike, convergence, folds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import grouped as G, paths as P


def cohort(spark, sizes=(300, 60, 40, 25), seed=5):
    rng = np.random.default_rng(seed)
    rows = []
    for k, n in enumerate(sizes):
        x, z = rng.normal(k, 2, n), rng.normal(size=n)
        c = rng.choice(["a", "b", "c"], n)
        p = 1 / (1 + np.exp(-(0.7 * (x - k) - 0.5 * z + (c == "c") - 0.3)))
        rows += [(len(rows) + i, f"g{k}", float(a), float(b), str(v), int(y), 2010 + i % 4) for i, (a, b, v, y) in enumerate(zip(x, z, c, rng.uniform(size=n) < p))]
    return rows, spark.createDataFrame(rows, "id long, g string, x double, z double, c string, y int, yr int")


def newton(rows, ridge):
    x = np.array([[r[2], r[3]] for r in rows])
    sd = x.std(axis=0)
    z = np.column_stack([np.ones(len(x)), (x - x.mean(axis=0)) / np.where(sd > 0, sd, 1), *[[float(r[4] == v) for r in rows] for v in "abc"]])
    y = np.array([r[5] for r in rows])
    b, pen = np.zeros(6), np.diag([0.0] + [ridge] * 5)
    for _ in range(80):
        p = 1 / (1 + np.exp(-z @ b))
        b = b + np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + pen + 1e-8 * np.eye(6), z.T @ (y - p) - pen @ b)
    return b, 1 / (1 + np.exp(-z @ b))


@pytest.mark.parametrize("block", [8192, 32])
def test_equals_a_fit_of_each_group(spark, monkeypatch, block):
    """Whether a group lies in one block or in ten."""
    monkeypatch.setattr(G, "BLOCK_ROWS", block)
    rows, df = cohort(spark)
    design = P.design_of(df, ["x", "z"], ["c"])
    coef = G.fit_grouped(df, ["g"], design, "y", 2.0)
    got = {r.g: r for r in coef.collect()}
    scores = {r.id: r.preds for r in G.score_groups(df, coef, ["g"], design).collect()}
    for g in ("g0", "g1", "g2", "g3"):
        own = [r for r in rows if r[1] == g]
        beta, preds = newton(own, 2.0)
        assert np.allclose(got[g].beta, beta, atol=1e-6) and got[g].converged and 2 < got[g].steps < 20
        assert got[g].n1 + got[g].n0 == len(own)
        assert np.allclose([scores[r[0]] for r in own], preds, atol=1e-6)


@pytest.mark.parametrize("block", [8192, 16])
def test_odd_groups(spark, monkeypatch, block):
    """One class, NULL keys, numbers and labels, a constant number, a separated group, unseen levels, steps that run out."""
    monkeypatch.setattr(G, "BLOCK_ROWS", block)
    rows = [(i, "one class", 1.0 * i, 0.0, "a", 1) for i in range(5)] + [(100 + i, None, 1.0, 1.0, "a", i % 2) for i in range(6)]
    rows += [(200 + i, "constant", 3.0, float(i), "b", i % 2) for i in range(40)] + [(300 + i, "apart", float(i), 0.0, None, int(i > 20)) for i in range(40)]
    rows += [(400 + i, "holes", None if i % 4 == 0 else float(i % 7), float(i), "a" if i % 2 else "b", None if i % 9 == 0 else int(i % 3 == 0)) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, g string, x double, z double, c string, y int").withColumn("mean", F.lit("clash")).withColumn("beta", F.lit(1))
    design = P.design_of(df, ["x", "z"], ["c"])
    coef = G.fit_grouped(df, ["g"], design, "y", 1.0)
    got = {r.g: r for r in coef.collect()}
    assert set(got) == {"constant", "apart", "holes"} and all(r.converged for r in got.values())
    assert got["constant"].sd[0] == 0 and got["constant"].beta[1] == 0
    assert got["holes"].n1 + got["holes"].n0 == sum(1 for r in rows if r[1] == "holes" and r[2] is not None and r[5] is not None)
    scored = G.score_groups(df.withColumn("c", F.lit("unseen")), coef, ["g"], design)
    assert scored.columns == [*[c for c in ["g"]], *[c for c in df.columns if c != "g"], "preds"]
    assert scored.filter("g = 'holes' and preds is null").count() == 15 and scored.filter("g in ('one class') or g is null").count() == 0
    short = {r.g: r for r in G.fit_grouped(df, ["g"], design, "y", 0.0, steps=2).collect()}
    assert not short["apart"].converged and short["apart"].steps == 2
    assert G.fit_grouped(df.limit(0), ["g"], design).count() == 0


def test_sub_models(spark):
    rows, df = cohort(spark, (300, 120))
    tests, valid, models = G.fit_sub_models(df, "yr", ["g"], ["x", "z"], ["c"], "y", (1.0, 100.0))
    assert sorted({(r.fold, r.ridge) for r in valid.collect()}) == [(2012, 1.0), (2012, 100.0), (2013, 1.0), (2013, 100.0)]
    held = {(r.fold, r.g, r.ridge): r for r in models.collect()}
    assert len(held) == 2 * 2 * 4
    final = held[None, "g1", 1.0]
    assert np.allclose(final.beta, newton([r for r in rows if r[1] == "g1"], 1.0)[0], atol=1e-6)
    late = held[2012, "g0", 100.0]
    assert np.allclose(late.beta, newton([r for r in rows if r[1] == "g0" and r[6] < 2012], 100.0)[0], atol=1e-6)
    assert tests.filter("ridge = 1.0").count() == sum(1 for r in rows if r[6] > 2010)
