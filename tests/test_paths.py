"""Paths on moments: against Spark ML, against plain fits on rows, and odd inputs."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from cohortlens.operators import impute as Im, models as M, paths as P


def made(spark, n=600, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4)) * [1, 5, 0.2, 1] + [0, 3, -1, 0]
    g = rng.choice(["a", "b", "c"], n, p=[0.6, 0.3, 0.1])
    y = x @ [1.0, -0.3, 0.0, 0.0] + (g == "c") * 2 + rng.normal(size=n) * 0.5
    rows = [(i, *map(float, r), str(k), float(v), i % 5) for i, (r, k, v) in enumerate(zip(x, g, y))]
    return x, g, y, spark.createDataFrame(rows, "id long, a double, b double, c double, d double, g string, y double, f int")


def test_equals_spark_ml(spark):
    _, _, _, df = made(spark)
    cols = ["a", "b", "c", "d"]
    lambdas = [0.5, 0.1, 0.02]
    path = P.lasso_cv(df, cols, "y", "f", lambdas=lambdas)
    ready = VectorAssembler(inputCols=cols, outputCol="features").transform(df)
    for k, lam in enumerate(lambdas):
        ml = LinearRegression(labelCol="y", elasticNetParam=1.0, regParam=lam, maxIter=500, tol=1e-12).fit(ready)
        assert np.abs(path.coefs[k] - [ml.intercept, *ml.coefficients]).max() < 1e-4


@pytest.mark.parametrize("mix", [1.0, 0.5])
def test_folds_by_subtraction(spark, mix):
    """Errors of a fold equal those of a path fitted on the other folds' rows; the optimum meets its conditions."""
    x, g, y, df = made(spark)
    path = P.lasso_cv(df, ["a", "b", "c", "d"], "y", "f", ["g"], count=12, mix=mix)
    assert path.design.names == ["a", "b", "c", "d", "g=a", "g=b", "g=c"]
    z = np.column_stack([np.ones(len(x)), x, *[(g == k).astype(float) for k in "abc"]])
    errors = []
    for f in range(5):
        on = np.arange(len(x)) % 5 != f
        m = P.Moments(z[on].T @ z[on], z[on].T @ y[on], float(y[on] @ y[on]), float(on.sum()))
        betas = P.descend(m, path.lambdas, mix)
        errors.append([np.mean((y[~on] - z[~on] @ b) ** 2) for b in betas])
    assert np.allclose(path.error, np.mean(errors, axis=0), rtol=1e-8)
    sd = z[:, 1:].std(axis=0)
    for lam, beta in zip(path.lambdas, path.coefs):
        grad = ((z[:, 1:] - z[:, 1:].mean(axis=0)) / sd).T @ (y - z @ beta) / len(y) - lam * (1 - mix) * beta[1:] * sd
        on = beta[1:] != 0
        assert np.allclose(grad[on], lam * mix * np.sign(beta[1:][on]), atol=1e-6) and np.all(np.abs(grad[~on]) <= lam * mix + 1e-6)
    assert not path.coefs[0, 1:].any() or mix < 1  # the first penalty empties the support
    within = path.error <= path.error[path.best] + path.se[path.best]
    assert path.chosen == int(np.flatnonzero(within)[0]) <= path.best


def test_odd_rows(spark):
    """NULL targets, numbers and levels, unseen levels, constant columns, clashing names, one fold, no rows."""
    _, _, _, df = made(spark, 200)
    odd = df.withColumn("b", F.when(F.col("id") % 7 != 0, F.col("b"))).withColumn("y", F.when(F.col("id") % 11 != 0, F.col("y")))
    odd = odd.withColumn("g", F.when(F.col("id") % 5 != 0, F.col("g"))).withColumn("one", F.lit(3.0)).withColumn("_x", F.lit("clash"))
    path = P.lasso_cv(odd, ["a", "b", "one"], "y", "f", ["g"], count=5)
    kept = odd.filter("b is not null and y is not null")
    assert path.total.n == kept.count()
    assert not path.coefs[:, 3].any()
    scored = path.predict(odd.withColumn("g", F.lit("never seen")), "p")
    assert scored.filter("p is null").count() == odd.filter("b is null").count()
    single = P.lasso_cv(odd.withColumn("f", F.lit(1)), ["a"], "y", "f", count=5)
    assert np.isnan(single.error).all() and single.chosen == 4
    with pytest.raises(ValueError, match="no complete rows"):
        P.lasso_cv(df.limit(0), ["a"], "y", "f")
    with pytest.raises(ValueError, match="levels"):
        P.learn_levels(df.select(F.col("id").cast("string").alias("g")), ["g"], most=50)


def test_stop_says_which_rule(spark):
    _, _, _, df = made(spark)
    met = P.sqrt_lasso_stop(df, ["a", "b", "c", "d"], "y", 12.0)
    assert met.rule == "target" and set(met.names) <= {"a", "b", "c", "d"} and "b" in met.names
    assert met.statistic[-1] < 12 and all(s >= 12 for s in met.statistic[:-1])
    never = P.sqrt_lasso_stop(df, ["a", "b", "c", "d"], "y", 0.0, count=10)
    assert never.rule == "end" and len(never.lambdas) == 10
    support, model, rule = M.sqrt_lasso_logit(df.withColumn("y", (F.col("y") > 0).cast("double")), ["a", "b", "c", "d"], "y", None, 8.0)
    assert rule == "target" and set(support) <= {"a", "b", "c", "d"} and M.score(model, df).filter("preds is null").count() == 0


def test_impute_with_levels(spark):
    _, g, y, df = made(spark, 800)
    target = df.withColumn("truth", F.col("y")).withColumn("y", F.when(F.col("id") % 3 != 0, F.col("y")))
    filled, quality = Im.lasso_impute(df, target, ["a", "b"], ["g"], "y", "f", "id")
    q = quality.first()
    assert q.metric == "r2" and q.value > 0.9 and filled.filter("y is null").count() == 0
    assert filled.filter("id % 3 = 0").agg(F.corr("y", "truth")).first()[0] > 0.9
    binary = df.withColumn("y", (F.col("y") > 0).cast("int"))
    filled, quality = Im.lasso_impute(binary, binary.withColumn("y", F.lit(None).cast("int")), ["a", "b"], ["g"], "y", "f", "id", binary=True)
    assert quality.first().metric == "auc" and quality.first().value > 0.9
    share = filled.agg(F.avg("y")).first()[0]
    assert abs(share - (y > 0).mean()) < 0.03
