"""Resampling and tests: fixed cases, exact sizes, independence of partitioning."""

import math

import pytest
from pyspark.sql import functions as F

from cohortlens.functions import dist
from cohortlens.operators import inference as I, resample as S


def test_standard_errors(spark):
    r = spark.createDataFrame([(0.8, 10, 20)], "auc double, n1 long, n0 long").select(
        I.auc_se(F.col("auc"), F.col("n1"), F.col("n0")), I.auc_se(F.col("auc"), F.col("n1"), F.col("n0"), "null")).first()
    assert r[0] == pytest.approx(0.0935711, abs=1e-7) and r[1] == pytest.approx(0.1136515, abs=1e-7)


def test_fdr(spark):
    df = spark.createDataFrame([("k", i, p) for i, p in enumerate([0.01, 0.04, 0.03, 0.5])], "k string, id long, p double")
    got = {r["id"]: r["fdr"] for r in I.fdr(df, ["k"], "p", "id").collect()}
    assert [got[i] for i in range(4)] == pytest.approx([0.04, 0.0533333333, 0.0533333333, 0.5])


def test_chi_square(spark):
    cells = {("a", "x"): 10, ("a", "y"): 20, ("b", "x"): 30, ("b", "y"): 40}
    df = spark.createDataFrame([(lv, sd) for (lv, sd), n in cells.items() for _ in range(n)], "level string, side string")
    r = I.chi_square(df, [], "level", "side", ["x", "y"]).first()
    assert r["stat"] == pytest.approx(0.4464286, abs=1e-6) and r["dof"] == 1
    assert r["pval"] == pytest.approx(math.erfc(math.sqrt(r["stat"] / 2)), abs=1e-9)


def test_enrichment_and_zero_cell(spark):
    df = spark.createDataFrame([("t", 1)] * 12 + [("t", 0)] * 10 + [("u", 1)] * 8 + [("u", 0)] * 30 + [("z", 1)] * 0, "term string, f int")
    r = {x["term"]: x for x in I.enrichment(df, [], "term", "f").collect()}
    assert r["t"]["lor"] == pytest.approx(1.5040774, abs=1e-6) and r["t"]["se"] == pytest.approx(0.5845225, abs=1e-6)
    only = spark.createDataFrame([("t", 1), ("u", 0)], "term string, f int")
    assert all(x["lor"] is None for x in I.enrichment(only, [], "term", "f").collect())


def test_order_threshold_and_sample_size(spark):
    df = spark.createDataFrame([(100, 0.05, 0.05), (100, 0.05, 0.10)], "n long, k double, j double")
    assert [r["rank"] for r in I.order_threshold(df, "n", "k", "j").orderBy("j").collect()][0] == 98
    g = spark.createDataFrame([(0.8,)], "power double")
    assert I.sample_size(g, "power", 0.5, 0.1, 0.05).first()["n_star"] == pytest.approx(150.4599, abs=1e-3)


@pytest.mark.parametrize("n,k,j", [(100, 0.05, 0.05), (100, 0.05, 0.1), (37, 0.2, 0.05), (5, 0.5, 0.4)])
def test_order_threshold_against_binomial_sums(spark, n, k, j):
    pdf = [math.comb(n, x) * (1 - k) ** x * k ** (n - x) for x in range(n + 1)]
    want = max([x for x in range(n + 1) if sum(pdf[:x]) <= 1 - j] + [1])
    df = spark.createDataFrame([(n, k, j)], "n long, k double, j double")
    assert I.order_threshold(df, "n", "k", "j").first()["rank"] == want


def test_distributions(spark):
    df = spark.createDataFrame([(x / 10,) for x in range(-45, 46)], "x double")
    for r in df.select("x", dist.norm_cdf(F.col("x")).alias("p"), dist.norm_ppf(dist.norm_cdf(F.col("x"))).alias("q")).collect():
        assert r["p"] == pytest.approx(0.5 * math.erfc(-r["x"] / math.sqrt(2)), abs=1e-7)
        if abs(r["x"]) < 3:
            assert r["q"] == pytest.approx(r["x"], abs=1e-4)
    assert float(dist.reg_gamma_upper(0.5, 3.841458820694124 / 2)) == pytest.approx(0.05, abs=1e-9)
    assert float(dist.reg_gamma_upper(5, 9.0)) == pytest.approx(math.exp(-9) * sum(9**i / math.factorial(i) for i in range(5)), rel=1e-9)
    assert float(dist.reg_beta(2, 3, 0.4)) == pytest.approx(sum(math.comb(4, i) * 0.4**i * 0.6 ** (4 - i) for i in range(2, 5)), rel=1e-9)
    assert float(dist.reg_beta(50, 3, 0.9)) == pytest.approx(sum(math.comb(52, i) * 0.9**i * 0.1 ** (52 - i) for i in range(50, 53)), rel=1e-8)


def test_exact_interval(spark):
    df = spark.createDataFrame([(0, 10), (3, 10), (10, 10)], "x long, n long")
    r = {x["x"]: x for x in I.prop_ci(df, "x", "n", "beta").collect()}
    assert r[0]["lb"] == 0 and r[0]["ub"] == pytest.approx(1 - 0.025 ** 0.1, abs=1e-9)
    assert r[10]["ub"] == 1 and r[10]["lb"] == pytest.approx(0.025 ** 0.1, abs=1e-9)
    below = sum(math.comb(10, i) * r[3]["ub"] ** i * (1 - r[3]["ub"]) ** (10 - i) for i in range(4))
    assert below == pytest.approx(0.025, abs=1e-8)


def strata(spark):
    return spark.createDataFrame([(i, "hot" if i % 3 else "b", i % 2, float(i % 11)) for i in range(300)], "id long, g string, y long, score double")


def test_replicates_have_exact_size(spark):
    df = strata(spark)
    sizes = {(r["g"], r["y"]): r["count"] for r in df.groupBy("g", "y").count().collect()}
    got = S.resample(df, ["g", "y"], ["id"], 6, 1).groupBy("g", "y", "rep").agg(F.sum("weight").alias("n")).collect()
    assert len(got) == 6 * len(sizes) and all(r["n"] == sizes[(r["g"], r["y"])] for r in got)


def test_draws_do_not_depend_on_partitioning(spark, rows):
    df = strata(spark)

    def run(parts):
        old = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            return rows(S.resample(df.repartition(int(parts)), ["g"], ["id"], 3, 5).select("id", "rep", "weight"))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", old)

    assert run("1") == run("7")


def test_resample_spread(spark):
    df = spark.range(400).select("id", F.lit("k").alias("k"), F.col("id").cast("double").alias("v"))
    m = S.resample(df, ["k"], ["id"], 80, 3).groupBy("rep").agg(
        (F.sum(F.col("v") * F.col("weight")) / F.sum("weight")).alias("m"), F.count(F.lit(1)).alias("d"))
    r = m.agg(F.stddev_samp("m").alias("sd"), F.avg("d").alias("d")).first()
    assert r["sd"] == pytest.approx(115.47 / 20, rel=0.3)
    assert r["d"] == pytest.approx(400 * (1 - math.exp(-1)), rel=0.03)


def test_poisson_weights(spark):
    df = spark.range(3000).select("id")
    r = S.resample_poisson(df, ["id"], 2, 9).groupBy("rep").agg(F.sum("weight").alias("n")).collect()
    assert all(abs(x["n"] - 3000) < 5 * math.sqrt(3000) for x in r)


def test_nested_replicates(spark):
    df = spark.range(50).select("id", F.lit("k").alias("k"))
    got = S.resample(df, ["k"], ["id"], 4, 2, subreps=3).groupBy("rep", "sub").agg(F.sum("weight").alias("n")).collect()
    assert len(got) == 16 and all(r["n"] == 50 for r in got)


def test_mann_whitney_without_difference(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(40)] + [("b", float(i)) for i in range(40)], "side string, x double")
    r = I.mann_whitney(df, [], "side", ("a", "b"), "x").first()
    assert r["u"] == 800 and r["z"] == 0 and r["pval"] == pytest.approx(1, abs=1e-6)


def test_quantile_bound_is_below_the_quantile(spark):
    df = spark.createDataFrame([(i, "m", (i * 37 % 101) / 100) for i in range(101)], "id long, mdl string, phat double")
    r = I.quantile_lower_bound(df, ["mdl"], "phat", "id", 0.5, 25, 8, 3).first()
    assert r["thresh"] == pytest.approx(0.5) and r["thresh_lb"] < r["thresh"]
