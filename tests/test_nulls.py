"""No operator loses a row or a value because another column is NULL."""

import math

import pytest
from pyspark.sql import functions as F

from cohortlens.operators import features as K, impute as P, joins as J, models as M, monitor as N, thresholds as T, windows as W


@pytest.fixture(scope="module")
def gaps(spark):
    """Group, value, label: a NULL group, a NULL value, both."""
    return spark.createDataFrame([(1, "a", 1.0), (2, "a", 3.0), (3, "a", None), (4, None, 5.0), (5, None, None), (6, "b", 2.0)], "id long, g string, v double")


def by_id(df, *cols):
    return {r["id"]: tuple(r[c] for c in cols) for r in df.collect()}


def test_group_aggregates_keep_null_keys(gaps):
    got = by_id(J.with_group_agg(gaps, ["g"], {"m": F.avg("v")}), "m")
    assert got == {1: (2.0,), 2: (2.0,), 3: (2.0,), 4: (None,), 5: (None,), 6: (2.0,)}


def test_group_mean_keeps_null_keys(gaps):
    assert by_id(W.impute_group_mean(gaps, ["g"], ["v"]), "v") == {1: (1.0,), 2: (3.0,), 3: (2.0,), 4: (5.0,), 5: (None,), 6: (2.0,)}


def test_share_above_keeps_null_values(gaps):
    got = by_id(W.share_above(gaps, ["g"], "v", "s"), "s")
    assert got == {1: (0.5,), 2: (0.0,), 3: (None,), 4: (None,), 5: (None,), 6: (0.0,)}


def test_bins_keep_null_keys(gaps):
    assert by_id(W.grid_bins(gaps, ["g"], "v", [0.0, 0.5, 1.0]), "bin") == {1: (None,), 2: (3.0,), 3: (None,), 4: (None,), 5: (None,), 6: (None,)}
    edges = gaps.sparkSession.createDataFrame([("a", 0.5, 2.0)], "g string, e0 double, e1 double")
    assert by_id(T.bins_by_edges(gaps, edges, ["g"], "v", ["e0", "e1"]), "bin") == {1: (1,), 2: (2,), 3: (None,), 4: (None,), 5: (None,), 6: (None,)}


def test_rolling_needs_a_full_frame_of_values(spark):
    rows = [(i, 1, float(i) if i != 4 else None) for i in range(10)]
    got = by_id(W.rolling_stats(spark.createDataFrame(rows, "id long, k long, v double"), ["k"], ["id"], "v", 3), "mu")
    assert [got[i][0] for i in range(10)] == [None, 1.0, 2.0, None, None, None, 6.0, 7.0, 8.0, None]


def test_fractional_levels_stay(spark):
    df = spark.createDataFrame([(i, i % 11 / 100, i % 3) for i in range(50)], "id long, d double, n int")
    got = by_id(K.discretise(df, df, ["d", "n"]), "d", "n")
    assert {v[0] for v in got.values()} == {str(i / 100) for i in range(11)} and {v[1] for v in got.values()} == {"0", "1", "2"}


def test_monitor_keeps_days_of_no_hit(spark):
    # day, label, flag: no event caught on the first two days
    rows = [("2024-01-01", 1, 0), ("2024-01-02", 1, 0), ("2024-01-02", 0, 1), ("2024-01-03", 1, 1), ("2024-01-04", 1, 1)]
    df = spark.createDataFrame(rows, "date string, y int, yhat int").withColumn("m", F.lit("x"))
    got = {r["date"]: r for r in N.monitor(df, [], "date", 0.5).collect()}
    assert sorted(got) == ["2024-01-01", "2024-01-02", "2024-01-03", "2024-01-04"]
    assert got["2024-01-01"]["zscore"] == -math.inf and got["2024-01-01"]["pval"] == 1.0 and 0 < got["2024-01-04"]["pval"] < 1
    # by route a day without a precision goes
    assert sorted(r["date"] for r in N.monitor(df, ["m"], "date", 0.5).collect()) == ["2024-01-02", "2024-01-03", "2024-01-04"]
    # a sensitivity of 1 has no test: the day goes without keys, stays by route
    sure = df.filter("yhat = 1 and y = 1")
    assert N.monitor(sure, [], "date", 0.5).count() == 0
    assert [r["pval"] for r in N.monitor(sure, ["m"], "date", 0.5).collect()] == [None, None]


@pytest.fixture(scope="module")
def cohort(spark):
    """400 rows, a tenth of the features NULL, targets partly NULL."""
    i = F.col("id")
    return (spark.range(400).withColumn("x", F.when(i % 10 != 3, (i * 37 % 100) / 100)).withColumn("c", F.when(i % 7 != 2, F.concat(F.lit("l"), (i % 3).cast("string"))))
            .withColumn("z", F.when(i % 10 != 5, (i * 53 % 90) / 90)).withColumn("y", ((i * 37 % 100) + (i * 11 % 40) > 70).cast("int"))
            .withColumn("b", F.when(i % 4 != 1, F.col("y"))).withColumn("v", F.when(i % 4 != 1, (i * 37 % 100) / 50 + (i % 5) / 10))
            .withColumn("cat", F.when(i % 4 != 1, F.when(i * 37 % 100 > 66, "hi").when(i * 37 % 100 > 33, "mid").otherwise("lo"))).withColumn("fold", (i % 3).cast("int")))


def test_scores_for_all_rows(cohort):
    model = M.fit_logistic(cohort, ["x", "z"])
    got = M.score(model, cohort).collect()
    assert len(got) == 400 and all((r["preds"] is None) == (r["x"] is None or r["z"] is None) for r in got)


def unchanged(before, after, col):
    old, new = by_id(before, col), by_id(after, col)
    return len(new) == 400 and all(new[i] == v for i, v in old.items() if v[0] is not None)


def test_imputation_keeps_all_rows(cohort):
    filled, _ = P.impute_binary(cohort, "b", ["c"], ["x", "z"], "id", reps=3)
    assert unchanged(cohort, filled, "b") and filled.filter("b is null").count() == 0
    filled, _ = P.impute_numeric(cohort, "v", ["c"], ["x", "z"], "id", reps=3)
    # only a row none of whose features tells anything stays open
    assert unchanged(cohort, filled, "v") and filled.filter("v is null and x is not null").count() == 0
    filled = P.impute_multiclass(cohort, "cat", ["lo", "mid", "hi"], ["c"], ["x", "z"], "id")
    assert unchanged(cohort, filled, "cat") and filled.filter("cat is null").count() == 0
    filled = P.regression_impute(cohort.filter("v is not null"), cohort, ["x", "z"], "v", "fold", [0.1, 0.01])
    assert unchanged(cohort, filled, "v") and all((r["v"] is None) == (r["x"] is None or r["z"] is None) for r in filled.filter("id % 4 = 1").collect())
