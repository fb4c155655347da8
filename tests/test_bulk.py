"""The bulk bootstrap against pair counting with the same weights."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.functions.draws import draw_bits
from cohortlens.operators import bulk, inference


def test_poisson_weights():
    w = bulk.poisson_weights(np.random.default_rng(1).integers(-2**63, 2**63 - 1, 20_000), 20)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02 and abs((w == 0).mean() - np.exp(-1)) < 0.005
    assert abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.03


@pytest.mark.parametrize("large,rows_at_once", [(10**9, 4096), (5, 7)])
def test_replicates(spark, monkeypatch, large, rows_at_once):
    monkeypatch.setattr(bulk, "LARGE_GROUP", large)
    monkeypatch.setattr(bulk, "ROWS_AT_ONCE", rows_at_once)
    df = spark.range(240).select(F.col("id"), (F.col("id") % 2).alias("k"), F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 11).alias("g"),
                                 F.when(F.col("id") % 29 == 5, None).otherwise((F.col("id") * 37 % 5 < 2).cast("int")).alias("y"), (F.col("id") * 53 % 23).cast("double").alias("score"))
    got = {(r.k, r.rep, r.tt): r.auc for r in bulk.decompose_replicates(df, ["k"], "g", ["id"], 6, 3).collect()}
    rows = [r for r in df.withColumn("h", draw_bits(3, "b", F.col("id"))).collect() if r.y is not None]
    w = bulk.poisson_weights(np.array([r.h for r in rows]), 6).astype(float)
    k, g, y, s = (np.array([r[c] for r in rows]) for c in ("k", "g", "y", "score"))
    won = (s[:, None] > s[None, :]) + 0.5 * (s[:, None] == s[None, :])
    for key in (0, 1):
        for rep in range(6):
            pairs = np.outer(w[:, rep] * (y == 1) * (k == key), w[:, rep] * (y == 0) * (k == key))
            same = g[:, None] == g[None, :]
            for tt, m in (("total", pairs), ("within", pairs * same), ("between", pairs * ~same)):
                assert got[key, rep + 1, tt] == pytest.approx((m * won).sum() / m.sum())
    assert len(got) == 36


@pytest.mark.parametrize("large", [10**9, 5])
def test_one_score_for_most_rows(spark, monkeypatch, large):
    """A tie that fills most buckets is many parts, and counts as one tie."""
    monkeypatch.setattr(bulk, "LARGE_GROUP", large)
    df = spark.range(400).select(F.col("id"), F.lit("k").alias("k"), (F.col("id") % 3).alias("g"), (F.col("id") * 37 % 5 < 2).cast("int").alias("y"),
                                 F.when(F.col("id") % 10 < 8, 1.0).otherwise(F.col("id") % 7 - 3.0).alias("score"))
    got = {(r.rep, r.tt): r.auc for r in bulk.decompose_replicates(df, ["k"], "g", ["id"], 4, 3).collect()}
    rows = df.withColumn("h", draw_bits(3, "b", F.col("id"))).collect()
    w = bulk.poisson_weights(np.array([r.h for r in rows]), 4).astype(float)
    g, y, s = (np.array([r[c] for r in rows]) for c in ("g", "y", "score"))
    won, same = (s[:, None] > s[None, :]) + 0.5 * (s[:, None] == s[None, :]), g[:, None] == g[None, :]
    for rep in range(4):
        pairs = np.outer(w[:, rep] * (y == 1), w[:, rep] * (y == 0))
        for tt, m in (("total", pairs), ("within", pairs * same), ("between", pairs * ~same)):
            assert got[rep + 1, tt] == pytest.approx((m * won).sum() / m.sum())


def test_bounds(spark):
    df = spark.range(2000).select(F.col("id"), F.lit(1).alias("k"), (F.col("id") % 5).alias("g"), (F.col("id") * 37 % 7 < 3).cast("int").alias("y"), (F.col("id") * 53 % 97).cast("double").alias("score"))
    for r in inference.decompose_bootstrap(df, ["k"], "g", ["id"], 60, 4, scheme="poisson").collect():
        assert r.lb < r.auc < r.ub and r.ub - r.lb < 0.2
