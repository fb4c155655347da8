"""Fits recover planted structure; folds and splits are exact; the stream equals the batch."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.functions.draws import draw_uniform
from cohortlens.operators import features as K, impute as Im, inference as I, models as M, monitor as Mo, ranking as R
from cohortlens.streaming import monitor_stream as MS


@pytest.fixture(scope="module")
def planted(spark):
    """4,000 rows, P(y=1) = sigmoid(-0.5 + 1.5 x1 - 1.0 x2), x3 noise, group 'hot' half of the rows."""
    u = lambda tag: draw_uniform(7, tag, F.col("id"))
    df = spark.range(4000).select("id", (u("a") * 2 - 1).alias("x1"), (u("b") * 2 - 1).alias("x2"), (u("c") * 2 - 1).alias("x3"),
                                  F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 7).cast("string"))).alias("g"),
                                  (F.lit(2012) + F.col("id") % 5).alias("yr"), u("y").alias("u"))
    p = 1 / (1 + F.exp(-(-0.5 + 1.5 * F.col("x1") - 1.0 * F.col("x2"))))
    return df.withColumn("y", (F.col("u") < p).cast("long")).drop("u").cache()


X = ["x1", "x2", "x3"]


def newton(x, y, ridge=0.0, steps=30):
    x = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(x.shape[1])
    pen = np.diag([0.0] + [ridge] * (x.shape[1] - 1))
    for _ in range(steps):
        mu = 1 / (1 + np.exp(-x @ b))
        b = b + np.linalg.solve((x * (mu * (1 - mu))[:, None]).T @ x + pen, x.T @ (y - mu) - pen @ b)
    mu = 1 / (1 + np.exp(-x @ b))
    return b, np.sqrt(np.diag(np.linalg.inv((x * (mu * (1 - mu))[:, None]).T @ x)))


def test_grouped_logit_equals_separate_fits(planted):
    fit = {r["g"]: r for r in M.fit_grouped_logit(planted, ["g"], X, ridge=1.0).collect()}
    pdf = planted.toPandas()
    assert len(fit) == pdf["g"].nunique()
    for g, part in pdf.groupby("g"):
        want, _ = newton(part[X].to_numpy(), part["y"].to_numpy(), 1.0)
        assert fit[g]["beta"] == pytest.approx(want.tolist(), abs=1e-5)


def test_one_class_group_has_no_model(spark):
    df = spark.createDataFrame([("a", 1, 0.1), ("a", 1, 0.2), ("b", 1, 0.3), ("b", 0, 0.1)], "g string, y long, x double")
    assert [r["g"] for r in M.fit_grouped_logit(df, ["g"], ["x"]).collect()] == ["b"]


def test_inference_matches_fisher(planted):
    got = {r["feature"]: r for r in M.logit_inference(planted.withColumn("k", F.lit(1)), ["k"], X).collect()}
    pdf = planted.toPandas()
    b, se = newton(pdf[X].to_numpy(), pdf["y"].to_numpy())
    for i, f in enumerate(["intercept", *X]):
        assert got[f]["coef"] == pytest.approx(b[i], abs=1e-5) and got[f]["se"] == pytest.approx(se[i], rel=1e-4)
    assert got["x1"]["pval"] < 1e-6 and got["x3"]["pval"] > 0.01


@pytest.mark.parametrize("kind,params", [("logit", {}), ("rf", {"depth": 4, "trees": 10}), ("gbt", {"depth": 2, "rounds": 4})])
def test_pooled_fits_beat_chance(planted, kind, params):
    train, test = planted.filter("yr < 2015"), planted.filter("yr >= 2015")
    a = R.auc(M.score(M.FITS[kind](train, X, **params), test), [], "y", "preds").first()["auc"]
    assert a > 0.7


def test_folds_expand(planted):
    lb = planted.withColumn("y", F.when(F.col("yr") == 2013, -1).otherwise(F.col("y")))
    got = {(r["fold"], r["role"]): r["yrs"] for r in K.expanding_folds(lb, "yr", "y").groupBy("fold", "role").agg(
        F.array_sort(F.collect_set("yr")).alias("yrs")).collect()}
    assert got == {(2014, "train"): [2012], (2014, "test"): [2014],
                   (2015, "train"): [2012], (2015, "valid"): [2014], (2015, "test"): [2015],
                   (2016, "train"): [2012, 2014], (2016, "valid"): [2015], (2016, "test"): [2016]}


def test_fit_folds_and_sub_models(planted):
    d = K.expanding_folds(planted, "yr", "y")
    tests, valids = M.fit_folds(d, [2014, 2016], ["y"], X)
    assert {r["fold"] for r in valids.collect()} == {2014, 2016}
    assert tests.count() == planted.filter("yr in (2014, 2016)").count()
    sub = M.fit_by_group(d.filter("fold = 2016"), ["g"], X)
    assert sub.count() == planted.filter("yr = 2016").count()
    assert R.auc(sub, [], "y", "preds").first()["auc"] > 0.7


def test_kfold_is_balanced(planted):
    n = K.kfold(planted, 4, ["y"], "id", 3).groupBy("y", "fold").count().groupBy("y").agg((F.max("count") - F.min("count")).alias("d")).collect()
    assert all(r["d"] <= 1 for r in n)


def test_permute_keeps_the_values(planted):
    out = K.permute(planted.select("id", "y", "x1"), "id", ["y"], 5)
    assert out.count() == planted.count() and out.agg(F.sum("y")).first() == planted.agg(F.sum("y")).first()
    assert abs(out.agg(F.corr("y", "x1")).first()[0]) < 0.06


def test_sample_n_exact(planted):
    got = K.sample_n(planted, ["g"], 100, "id", 4).groupBy("g").agg(F.sum("weight").alias("n")).collect()
    assert all(r["n"] == 100 for r in got)


def test_naive_bayes_group_only(spark):
    df = spark.createDataFrame([("a", 1)] * 8 + [("a", 0)] * 2 + [("b", 1)] * 2 + [("b", 0)] * 8, "g string, y long")
    table, tot = M.bernoulli_table(df, ["g"])
    got = {r["g"]: r["p"] for r in M.bernoulli_scores(df.select("g").distinct(), table, tot, ["g"], "p").collect()}
    pa1, pa0, pb1, pb0 = 9 / 12, 3 / 12, 3 / 12, 9 / 12
    odds = (pa1 / pa0) * ((1 - pb1) / (1 - pb0))
    assert got["a"] == pytest.approx(odds / (1 + odds))


def test_univariate_average_equals_ols(planted):
    t = {r["name"]: r for r in M.univariate_fit(planted, ["g"], X, "y").collect()}
    pdf = planted.toPandas()
    slope, intercept = np.polyfit(pdf["x1"], pdf["y"], 1)
    assert (t["x1"]["b1"], t["x1"]["b0"]) == pytest.approx((slope, intercept))
    assert t["x1"]["weight"] > 0 and t["x3"]["weight"] == 0


def test_ridge_path_zero_is_ols(planted):
    beta, history = M.ridge_path(planted, planted, X, "y", [0.0])
    pdf = planted.toPandas()
    x = np.column_stack([np.ones(len(pdf)), pdf[X]])
    assert beta == pytest.approx(np.linalg.lstsq(x, pdf["y"], rcond=None)[0], abs=1e-9)
    assert len(history) == 1


@pytest.mark.parametrize("kind", ["lda", "qda"])
def test_discriminant_separates(spark, kind):
    rng = np.random.default_rng(1)
    data = [(int(k), *(rng.normal(size=2) * (1 + k) + 4 * k)) for k in (0, 1, 2) for _ in range(60)]
    df = spark.createDataFrame([(a, float(b), float(c)) for a, b, c in data], "k int, a double, b double")
    out = M.discriminant(df, df, ["a", "b"], "k", kind)
    assert out.filter("pred = k").count() > 150


def test_concordance_recovers_direction(planted):
    w, _ = M.fit_concordance(planted.filter("yr < 2015"), planted.filter("yr = 2015"), "within", "g", "id", X, [0.001], 1500)
    assert w[0] > 0.8 and w[1] < -0.4 and abs(w[2]) < 0.4


def test_multi_output_calibration(planted):
    noisy = (F.col("x3") + draw_uniform(9, "z", F.col("id")) * 2 > 1.3).cast("long")
    s = M.multi_output_logit(planted.withColumn("y2", noisy), X, ["y", "y2"], ["id"])
    for r in s.groupBy("label").agg(F.avg("preds").alias("p"), F.avg("y").alias("y")).collect():
        assert r["p"] == pytest.approx(r["y"], abs=1e-3)


def test_mode_drop_encoder_maps_unseen_to_mode(spark):
    train = spark.createDataFrame([("a",)] * 5 + [("b",)] * 2 + [("c",)], "v string")
    out = K.ModeDropEncoder(["v"]).fit(train).transform(spark.createDataFrame([("a",), ("b",), ("new",)], "v string"))
    vecs = [r["v_vec"].toArray().tolist() for r in out.collect()]
    assert vecs == [[0.0, 0.0], [0.0, 1.0], [0.0, 0.0]]


def test_impute_models(planted):
    d = planted.withColumn("v", F.when(F.col("id") % 5 != 0, F.col("y")).cast("int"))
    filled, quality = Im.impute_binary(d, "v", ["g"], X, "id", reps=8)
    assert filled.filter("v is null").count() == 0 and filled.filter("id % 5 <> 0 and v <> y").count() == 0
    q = quality.first()
    assert q["stat"] > 0.65 and q["lb"] <= q["ub"]


def test_save_and_load(planted, tmp_path):
    m = M.fit_logistic(planted, X)
    M.save_model(m, str(tmp_path / "m"))
    a, b = (M.score(x, planted).agg(F.sum("preds")).first()[0] for x in (m, M.load_model(str(tmp_path / "m"))))
    assert a == pytest.approx(b)


def monitored(spark):
    return spark.range(3000).select(
        F.timestamp_micros(F.lit(1_704_067_200_000_000) + (F.col("id") % 20) * 86_400_000_000 + F.col("id") * 1000).alias("ts"),
        (draw_uniform(1, "y", F.col("id")) < 0.2).cast("long").alias("y"), (draw_uniform(1, "h", F.col("id")) < 0.5).cast("long").alias("yhat"))


def test_stream_equals_batch(spark, tmp_path, rows):
    df = monitored(spark)
    folder = str(tmp_path / "in")
    df.repartition(3).write.parquet(folder)
    stream = spark.readStream.schema(df.schema).parquet(folder)
    got = MS.monitor_stream(stream, 0.4)
    batch = Mo.monitor(df.withColumn("date", F.to_date("ts")), [], "date", 0.4)
    last = got.agg(F.max("date")).first()[0]
    cols = ["date", "n_rt", "y", "tp", "fp", "sens", "pval"]
    assert got.count() >= 17
    assert rows(got.select(*cols)) == rows(batch.filter(F.col("date") <= F.lit(last)).select(*cols))


def test_stream_goes_on_from_its_folder(spark, tmp_path, rows):
    df, folder, state = monitored(spark), str(tmp_path / "in"), str(tmp_path / "state")
    early = df.filter(F.to_date("ts") < F.lit("2024-01-10"))
    early.coalesce(1).write.parquet(folder)
    stream = spark.readStream.schema(df.schema).parquet(folder)
    first = MS.monitor_stream(stream, 0.4, folder=state)
    n = first.count()
    df.exceptAll(early).coalesce(1).write.mode("append").parquet(folder)
    second = MS.monitor_stream(spark.readStream.schema(df.schema).parquet(folder), 0.4, folder=state)
    batch = Mo.monitor(df.withColumn("date", F.to_date("ts")), [], "date", 0.4)
    cols = ["date", "n_rt", "y", "tp", "fp", "sens", "pval"]
    last = second.agg(F.max("date")).first()[0]
    assert 0 < n < second.count()
    assert rows(second.select(*cols)) == rows(batch.filter(F.col("date") <= F.lit(last)).select(*cols))


def test_power_between_grid_points(spark):
    grid = spark.createDataFrame([(0.2, 100.0), (0.4, 300.0)], "power double, n double")
    m = spark.createDataFrame([(50,), (100,), (200,), (300,), (900,)], "n_rt long")
    got = {r["n_rt"]: r["power"] for r in Mo.power_at(m, grid, "n").collect()}
    assert got == pytest.approx({50: 0.2, 100: 0.2, 200: 0.3, 300: 0.4, 900: 0.4})


def test_spearman_bounds_hold_the_estimate(spark):
    df = spark.createDataFrame([("p", i, float(i), float((i * 7) % 40) + i) for i in range(60)], "k string, id long, a double, b double")
    r = {x["tt"]: x for x in I.spearman_ci(df, ["k"], "a", "b", "id", 25, 8, 3).collect()}
    assert set(r) == {"student", "normal", "quant"} and all(x["lb"] < x["rho"] < x["ub"] for x in r.values())
