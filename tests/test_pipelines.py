"""Fits on mixed columns: stored models, NULLs and unseen levels, periods."""

import json

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from cohortlens.operators import features as K, pipelines as Pi


def cohort(spark, n=900, seed=3):
    rng = np.random.default_rng(seed)
    x, z = rng.normal(2, 3, n), rng.normal(size=n)
    g = rng.choice(["a", "b", "c"], n, p=[0.5, 0.3, 0.2])
    eta = 0.6 * (x - 2) - 0.4 * z + 1.5 * (g == "c") - 0.8
    y = (rng.uniform(size=n) < 1 / (1 + np.exp(-eta))).astype(int)
    rows = [(i, float(a), float(b), str(k), int(v), 2010 + i % 5) for i, (a, b, k, v) in enumerate(zip(x, z, g, y))]
    return x, z, g, y, spark.createDataFrame(rows, "id long, x double, z double, g string, y int, yr int")


def newton(design, y, ridge, steps=60):
    b = np.zeros(design.shape[1])
    pen = np.diag([0.0] + [ridge] * (design.shape[1] - 1))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-design @ b))
        b = b + np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + pen + 1e-12 * np.eye(len(b)), design.T @ (y - p) - pen @ b)
    return b


def test_logistic_is_the_penalised_optimum(spark):
    x, z, g, y, df = cohort(spark)
    scaled = [(v - v.mean()) / v.std(ddof=1) for v in (x, z)]
    design = np.column_stack([np.ones(len(x)), *scaled, *[(g == k).astype(float) for k in "abc"]])
    want = 1 / (1 + np.exp(-design @ newton(design, y, 1 / 0.5)))
    model = Pi.fit_mixed(df, "logit", ["x", "z"], ["g"], c=0.5)
    got = {r.id: r.preds for r in Pi.score_mixed(model, df).collect()}
    assert max(abs(got[i] - want[i]) for i in got) < 1e-3


@pytest.mark.parametrize("kind, options", [("logit", {"c": 1.0}), ("rf", {"trees": 5, "depth": 3}), ("gbt", {"rounds": 3})])
def test_store_load_score(spark, tmp_path, kind, options):
    """NULL and unseen levels score as none, a NULL number gives NULL, columns named like results stay."""
    *_, df = cohort(spark)
    estimator = Pi.MixedClassifier(numCols=["x", "z"], catCols=["g"], kind=kind, options=json.dumps(options))
    estimator.write().save(f"{tmp_path}/estimator")
    estimator = Pi.MixedClassifier.load(f"{tmp_path}/estimator")
    holes = df.withColumn("x", F.when(F.col("id") % 50 != 0, F.col("x"))).withColumn("y", F.when(F.col("id") % 40 != 0, F.col("y")))
    model = Pipeline(stages=[estimator]).fit(holes)  # a stage among others
    model.write().save(f"{tmp_path}/model")
    inner = PipelineModel.load(f"{tmp_path}/model").stages[0]
    odd = df.withColumn("g", F.when(F.col("id") % 3 == 0, "new").when(F.col("id") % 3 == 1, F.col("g")))
    odd = odd.withColumn("z", F.when(F.col("id") % 7 != 0, F.col("z"))).withColumn("features", F.lit("mine")).withColumn("probability", F.col("id"))
    got = Pi.score_mixed(inner, odd)
    assert got.columns == [*odd.columns, "preds"]
    assert got.filter("preds is null").count() == odd.filter("z is null").count() == got.filter("id % 7 = 0").count()
    none = Pi.score_mixed(inner, odd.withColumn("g", F.lit(None).cast("string"))).withColumnRenamed("preds", "p")
    both = got.filter("id % 3 <> 1").join(none.select("id", "p"), "id")
    assert both.filter("abs(preds - p) > 1e-12").count() == 0
    assert Pi.score_mixed(inner, odd.limit(0)).count() == 0
    with pytest.raises(ValueError, match="rows by label"):
        estimator.fit(df.filter("y = 1"))


def test_periods(spark, tmp_path):
    *_, df = cohort(spark)
    df = df.withColumn("w", F.when(F.col("yr") != 2011, 1 - F.col("y")))  # a label that one year lacks
    fits = Pi.fit_periods(df, "yr", ["y", "w"], ["x", "z"], ["g"], f"file://{tmp_path}", "logit", [{"c": 1e-7}, {"c": 1.0}], keep=["id"])
    models = {(r.outcome, r.fold): r for r in fits.models.collect()}
    assert sorted((o, f) for o, f in models if f) == [("w", 2012), ("w", 2013), ("w", 2014), ("y", 2011), ("y", 2012), ("y", 2013), ("y", 2014)]
    assert {o for o, f in models if f is None} == {"y", "w"}
    valid = fits.valid.collect()
    assert len(valid) == 2 * (2 + 3) and all(0 < r.auc < 1 for r in valid)
    for (o, f), r in models.items():
        tried = [(v.auc, -v.c, v.params) for v in valid if (v.outcome, v.fold) == (o, f or 2014)]
        assert r.params == (max(tried)[2] if tried else '{"c": 1e-07}')
    tests = fits.tests
    assert tests.columns == ["id", "y", "outcome", "fold", "preds"]
    assert tests.filter("outcome = 'y'").count() == df.filter("yr > 2010").count()
    own = Pi.fit_mixed(df, "logit", ["x", "z"], ["g"], "y", **json.loads(models["y", None].params))
    a = {r.id: r.preds for r in Pi.score_mixed(own, df).collect()}
    b = {r.id: r.preds for r in Pi.score_mixed(PipelineModel.load(models["y", None].path), df).collect()}
    assert max(abs(a[i] - b[i]) for i in a) < 1e-9


def test_mode_drop_encoder_is_a_stage(spark, tmp_path):
    *_, df = cohort(spark)
    K.ModeDropEncoder(["g"]).write().save(f"{tmp_path}/e")
    model = Pipeline(stages=[K.ModeDropEncoder.load(f"{tmp_path}/e")]).fit(df)
    model.write().save(f"{tmp_path}/m")
    out = PipelineModel.load(f"{tmp_path}/m").transform(spark.createDataFrame([("a",), ("b",), ("c",), ("new",), (None,)], "g string"))
    got = {r.g: r.g_vec.toArray().tolist() for r in out.collect()}
    assert got == {"a": [0, 0], "b": [0, 1], "c": [1, 0], "new": [0, 0], None: [0, 0]}
