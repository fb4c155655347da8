"""Count tables of several classes and of several columns and windows at once."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cohortlens.operators import class_tables as Ct, impute as Im


def cohort(spark, n=500, seed=4):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        k = rng.choices(["base", "large", "mid"], [5, 2, 3])[0]
        g = rng.choices("abc", {"base": [8, 1, 1], "large": [1, 8, 1], "mid": [2, 2, 6]}[k])[0]
        rows.append((i, k, g, rng.choice("xy"), 2010 + i % 4))
    return rows, spark.createDataFrame(rows, "id long, k string, g string, h string, yr int")


def test_posteriors_are_those_of_a_bernoulli_model(spark):
    rows, df = cohort(spark)
    classes, got = Ct.class_posteriors(df, df, "k", ["g", "h"])
    assert classes == ["base", "large", "mid"]
    n = Counter(r[1] for r in rows)
    hits = Counter((r[1], c, v) for r in rows for c, v in (("g", r[2]), ("h", r[3])))
    levels = [("g", v) for v in "abc"] + [("h", v) for v in "xy"]
    for row in got.limit(50).collect():
        on = {("g", row.g), ("h", row.h)}
        logs = [math.log(n[k] / len(rows)) + sum(math.log(p if lv in on else 1 - p) for lv in levels for p in [(hits[k, *lv] + 1) / (n[k] + 2)]) for k in classes]
        total = sum(math.exp(x) for x in logs)
        assert row.posterior == pytest.approx([math.exp(x) / total for x in logs], abs=1e-8)


def test_fill_keeps_rows_and_shares(spark):
    rows, df = cohort(spark, 1000)
    holes = df.withColumn("truth", F.col("k")).withColumn("k", F.when(F.col("id") % 4 != 0, F.col("k"))).withColumn("_posterior", F.lit(1))
    out = Ct.impute_classes(holes, "k", ["g", "h"])
    assert out.columns == holes.columns and out.count() == 1000 and out.filter("k is null").count() == 0
    assert out.filter("id % 4 <> 0 and k <> truth").count() == 0
    filled = out.filter("id % 4 = 0")
    assert filled.filter("k = truth").count() > 0.6 * 250


def test_odd_columns(spark):
    """One class, no known value, NULL and unseen levels, an empty table."""
    df = spark.createDataFrame([(1, "a", "x"), (2, None, "x"), (3, None, None)], "id long, k string, g string")
    assert [r.k for r in Ct.impute_classes(df, "k", ["g"]).orderBy("id").collect()] == ["a", "a", "a"]
    assert Ct.impute_classes(df.filter("k is null"), "k", ["g"]).filter("k is null").count() == 2
    assert Ct.impute_classes(df.limit(0), "k", ["g"]).count() == 0
    two = spark.createDataFrame([(i, "ab"[i % 2], "xy"[i % 2]) for i in range(40)] + [(90, None, None), (91, None, "unseen"), (92, None, "y")], "id long, k string, g string")
    got = {r.id: r.k for r in Ct.impute_classes(two, "k", ["g"]).filter("id >= 90").collect()}
    assert got[92] == "b" and set(got.values()) <= {"a", "b"}
    numbers = two.withColumn("k", F.when(F.col("k") == "a", 10).when(F.col("k") == "b", 20))
    assert Ct.impute_classes(numbers, "k", ["g"]).filter("id = 92").first().k == 20


def test_gate_equals_a_loop(spark):
    """All columns and periods at once give what fits of each window give."""
    rows, df = cohort(spark, 400)
    df = df.withColumn("big", (F.col("k") == "large").cast("int")).withColumn("odd", F.when(F.col("yr") > 2010, (F.col("g") == "a").cast("int")))
    got = {r.name: r for r in Ct.gate_columns(df, ["big", "odd"], "yr", ["g", "h"], "id").collect()}
    for name, years in (("big", [2011, 2012, 2013]), ("odd", [2012, 2013])):
        aucs = []
        for yr in years:
            known = [(r[2], r[3], int(r[1] == "large") if name == "big" else int(r[2] == "a"), r[4]) for r in rows if name == "big" or r[4] > 2010]
            train, test = [r for r in known if r[3] < yr], [r for r in known if r[3] == yr]
            n = Counter(r[2] for r in train)
            c = Counter((j, r[j], r[2]) for r in train for j in (0, 1))
            p = lambda j, v, y: (c[j, v, y] + 1) / (n[y] + 2)
            levels = {(j, r[j]) for r in train for j in (0, 1)}
            eta = lambda r: sum(math.log((p(j, v, 1) if r[j] == v else 1 - p(j, v, 1)) / (p(j, v, 0) if r[j] == v else 1 - p(j, v, 0))) for j, v in levels)
            s1, s0 = [round(eta(r), 6) for r in test if r[2]], [round(eta(r), 6) for r in test if not r[2]]
            aucs.append(sum((a > b) + (a == b) / 2 for a in s1 for b in s0) / (len(s1) * len(s0)))
        assert got[name].auc == pytest.approx(sum(aucs) / len(aucs), abs=1e-6)
    assert Ct.gate_columns(df.limit(0), ["big"], "yr", ["g"], "id").count() == 0
    assert Ct.gate_columns(df.filter("yr = 2010"), ["big", "odd"], "yr", ["g"], "id").count() == 0


def test_quality_for_each_period(spark):
    rows, df = cohort(spark, 600)
    d = df.withColumn("v", F.when(F.col("id") % 7 != 0, (F.col("k") == "large").cast("int"))).withColumn("x", (F.col("id") % 13).cast("double"))
    _, quality = Im.impute_binary(d, "v", ["g", "h"], ["x"], "id", reps=4, period="yr")
    assert sorted(r.yr for r in quality.collect()) == ["2010", "2011", "2012", "2013", "all"]
    assert quality.filter("lb <= ub or stat is null").count() == 5 and quality.filter("yr = 'all'").first().stat > 0.6
