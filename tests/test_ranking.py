"""AUROC and its decomposition: hand-checked cases, brute force, identities, edge cases."""

import math
import random

import pytest
from pyspark.sql import functions as F

from cohortlens.operators import ranking as R, thresholds as T, windows as W


def frame(spark, y, s, g=None):
    g = g or ["a"] * len(y)
    return spark.createDataFrame(list(zip(range(len(y)), y, map(float, s), map(str, g))), "id long, y long, score double, g string")


def parts(df):
    return {r["tt"]: (r["auc"], r["den"]) for r in df.collect()}


CASES = [
    ([0, 1, 0, 1, 1, 1], [0, 1, 1.5, 3, 2, 10], "aabbbc", (0.875, 8), (1.0, 3), (0.8, 5)),
    ([0, 1, 1, 0, 0, 1], [2, 2, 2, 1, 1, 1], "111222", (6 / 9, 9), (0.5, 4), (0.8, 5)),
    ([1, 1, 1, 1, 0, 0, 0, 1], [6, 5, 7, 5, 3, 2, 2, 1], "aababbbc", (0.8, 15), (1.0, 3), (0.75, 12)),
]


@pytest.mark.parametrize("y,s,g,total,within,between", CASES)
def test_decomposition_cases(spark, y, s, g, total, within, between):
    got = parts(R.auc_decompose(frame(spark, y, s, list(g)), [], "g"))
    for name, want in (("total", total), ("within", within), ("between", between)):
        assert got[name] == pytest.approx(want)


def test_group_table_keeps_positive_only_groups(spark):
    y, s, g = CASES[2][:3]
    t = {r["g"]: r for r in R.auc_by_group(frame(spark, y, s, list(g)), [], "g").collect()}
    assert t["a"]["n0n1"] == 0 and t["a"]["auc"] is None and t["c"]["n0n1"] == 0
    assert t["b"]["auc"] == 1.0
    only_negative = R.auc_by_group(frame(spark, [0, 0, 1], [1, 2, 3], ["n", "n", "p"]), [], "g")
    assert [r["g"] for r in only_negative.collect()] == ["p"]


def brute(y, s, w=None):
    w = w or [1] * len(y)
    num = den = 0.0
    for yi, si, wi in zip(y, s, w):
        for yj, sj, wj in zip(y, s, w):
            if yi == 1 and yj == 0:
                den += wi * wj
                num += wi * wj * (1 if si > sj else 0.5 if si == sj else 0)
    return num / den


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_auc_equals_pair_loop_and_midrank(spark, seed):
    rnd = random.Random(seed)
    n = 120
    y = [rnd.randint(0, 1) for _ in range(n)]
    s = [rnd.choice([rnd.random(), round(rnd.random(), 1), 0.5]) for _ in range(n)]
    df = frame(spark, y, s)
    got = R.auc(df, []).first()
    assert got["auc"] == pytest.approx(brute(y, s))
    rank = W.midrank(df, [], "score").filter("y = 1").agg(F.sum("rank")).first()[0]
    n1 = sum(y)
    assert (rank - n1 * (n1 + 1) / 2) / (n1 * (n - n1)) == pytest.approx(got["auc"])
    flipped = R.auc(df.withColumn("score", -F.col("score")), []).first()["auc"]
    assert flipped == pytest.approx(1 - got["auc"])
    same = R.auc(df.withColumn("score", F.exp("score") * 3), []).first()["auc"]
    assert same == pytest.approx(got["auc"])


def test_weighted_auc(spark):
    y, s, w = [1, 0, 1, 0, 0], [3, 2, 1, 1, 5], [2, 1, 3, 4, 1]
    df = spark.createDataFrame(list(zip(y, map(float, s), w)), "y long, score double, w long")
    assert R.auc(df, [], weight="w").first()["auc"] == pytest.approx(brute(y, s, w))


def test_identity_and_pair_counts(spark):
    rnd = random.Random(7)
    y = [rnd.randint(0, 1) for _ in range(200)]
    s = [round(rnd.random(), 2) for _ in y]
    g = [rnd.choice("abcde") for _ in y]
    got = parts(R.auc_decompose(frame(spark, y, s, g), [], "g"))
    (t, n), (w, nw), (b, nb) = got["total"], got["within"], got["between"]
    assert n == nw + nb and t * n == pytest.approx(w * nw + b * nb, rel=1e-12)


def test_hot_group_matches_brute_force(spark):
    rnd = random.Random(11)
    y = [rnd.randint(0, 1) for _ in range(300)]
    s = [rnd.random() if rnd.random() < 0.6 else 0.25 for _ in y]
    g = ["hot" if rnd.random() < 0.5 else rnd.choice("abc") for _ in y]
    t = {r["g"]: r["auc"] for r in R.auc_by_group(frame(spark, y, s, g), [], "g").collect()}
    for k in set(g):
        idx = [i for i, v in enumerate(g) if v == k]
        assert t[k] == pytest.approx(brute([y[i] for i in idx], [s[i] for i in idx]))


def test_edge_cases(spark):
    assert R.auc(frame(spark, [1, 1], [1, 2]), []).first()["auc"] is None
    assert R.auc(frame(spark, [1, 0, 1, 0], [2, 2, 2, 2]), []).first()["auc"] == 0.5
    assert R.auc(frame(spark, [1], [1]), ["g"]).collect()[0]["den"] == 0
    assert R.auc(frame(spark, [], []), ["g"]).collect() == []
    with_gap = spark.createDataFrame([(1, 3.0), (0, None), (0, 1.0), (-1, 9.0)], "y long, score double")
    got = R.auc(with_gap, []).first()
    assert (got["n1"], got["n0"], got["auc"]) == (1, 1, 1.0)


def test_ordinal_and_average_precision(spark):
    o = spark.createDataFrame([(0, 1.0), (0, 2.0), (1, 2.0), (2, 3.0)], "lv long, s double")
    assert R.auc_ordinal(o, [], "lv", "s", [0, 1, 2]).first()["auc"] == pytest.approx(0.9)
    y, s = CASES[0][:2]
    assert R.avg_precision(frame(spark, y, s), []).first()["ap"] == pytest.approx(0.95)


def test_thresholds(spark):
    y, s, g = CASES[1][:3]
    df = frame(spark, y, s)
    assert T.sens_spec(df, [], 2.0).first()["sens"] == 0.0
    assert T.ppv_at(df, [], 2.0).first()["ppv"] == pytest.approx(2 / 3)


@pytest.mark.parametrize("fn,kind", [(T.roc_grid, "roc"), (T.pr_grid, "pr")])
def test_grids_against_direct_counts(spark, fn, kind):
    rnd = random.Random(5)
    y = [rnd.randint(0, 1) for _ in range(80)]
    s = [round(rnd.random(), 2) for _ in y]
    pos = [a for a, b in zip(s, y) if b]
    lo, hi, num = min(pos) * 0.99, max(pos) * (1.01 if kind == "roc" else 0.99), 25
    got = {r["j"]: r for r in fn(frame(spark, y, s), [], num).collect()}
    for j in range(num):
        t = lo + j * ((hi - lo) / (num - 1))
        assert got[j]["tpr"] == pytest.approx(sum(b == 1 and a > t for a, b in zip(s, y)) / sum(y))
        if kind == "roc":
            assert got[j]["fpr"] == pytest.approx(sum(b == 0 and a > t for a, b in zip(s, y)) / (len(y) - sum(y)))
        else:
            hit = [b for a, b in zip(s, y) if a >= t]
            assert got[j]["precision"] == pytest.approx(sum(hit) / len(hit))


def test_single_score_grid(spark):
    g = T.threshold_grid(frame(spark, [1, 0], [2.0, 2.0]), [], 5, 1.0, 1.0).collect()
    assert {(r["p_gt"], r["p_ge"]) for r in g} == {(0, 1)}


def test_one_class_threshold_is_missing(spark):
    assert T.threshold_for(frame(spark, [0, 0], [1, 2]), ["g"], 0.5, "sens").collect() == []
    assert not math.isnan(T.threshold_for(frame(spark, [1, 0], [1, 2]), [], 0.5, "sens").first()["thresh"])
