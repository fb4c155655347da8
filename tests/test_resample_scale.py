"""Draws in packed blocks, and inputs that are made once for many fits."""

from hashlib import md5

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cohortlens.functions import hashed as H
from cohortlens.functions.draws import draw_index
from cohortlens.operators import bulk as B, impute as Im, inference as I, models as M, pipelines as Pi, resample as S


def _table(spark, n=300):
    return spark.range(n).select(F.col("id").alias("caseid"), (F.col("id") % 3).cast("string").alias("g"), (F.col("id") % 2).alias("y"),
                                 (F.col("id") * 7 % 11).cast("double").alias("score"))


def _has_broadcast(df):
    return "BroadcastHashJoin" in df._jdf.queryExecution().executedPlan().toString()


def test_rows_and_draws_do_not_go_through_the_driver(spark):
    assert not _has_broadcast(S.resample(_table(spark), ["g"], ["caseid"], 3, 5))


def test_draws_by_definition_across_blocks(spark, monkeypatch):
    d = _table(spark)
    for subreps in (0, 2):
        monkeypatch.setattr(S, "DRAWS_AT_ONCE", 70)  # several ranges and blocks in a stratum
        monkeypatch.setattr(S, "WEIGHTS_AT_ONCE", 90)
        got = {(r.g, r.rep, r.sub if subreps else 0, r.caseid): r.weight for r in S.resample(d, ["g"], ["caseid"], 4, 5, subreps).collect()}
        at = d.select("g", (F.floor(F.col("caseid") / 3) + 1).alias("i"), F.explode(F.sequence(F.lit(1), F.lit(4))).alias("rep")).select("*", F.explode(F.sequence(F.lit(0), F.lit(subreps))).alias("sub"))
        n = F.lit(100)
        at = at.withColumn("j", F.when(F.col("sub") == 0, F.col("i")).otherwise(draw_index(n, 5, "s", F.col("g"), F.col("rep"), F.col("sub"), F.col("i")) + 1))
        drawn = at.select("g", "rep", "sub", (draw_index(n, 5, "r", F.col("g"), F.col("rep"), F.col("j")) * 3 + F.col("g").cast("int")).alias("caseid"))
        assert got == {(r.g, r.rep, r["sub"], r.caseid): r["count"] for r in drawn.groupBy("g", "rep", "sub", "caseid").count().collect()}


def test_no_rows_give_no_draws(spark):
    assert S.resample(_table(spark).limit(0), ["g"], ["caseid"], 3, 5).count() == 0


def test_edges_of_a_bootstrap_come_from_the_rows(spark, monkeypatch):
    seen = []
    made = I.auc_from_histogram
    monkeypatch.setattr(I, "auc_from_histogram", lambda hist, keys, s="score", sketch_from=None: seen.append(sketch_from) or made(hist, keys, s, sketch_from))
    I.bootstrap_ci(_table(spark), ["g"], "auc", ["caseid"], 3, 5)
    assert len(seen) == 2 and not any("weight" in str(x._jdf.queryExecution().analyzed()) for x in seen)


def _counted(spark, n=400):
    """A table that counts how often its rows are made."""
    made = spark.sparkContext.accumulator(0)

    def note(batches):
        for b in batches:
            made.add(len(b))
            yield b

    d = spark.range(n).select("id", (F.col("id") % 4 + 2000).alias("yr"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("c"), (F.col("id") * 37 % 101 / 20.0).alias("x"),
                              (F.col("id") * 37 % 101 + F.col("id") * 13 % 7 * 5 > 60).cast("long").alias("y"))
    return d.mapInPandas(note, d.schema), made


def test_each_fit_reads_the_written_copy(spark):
    d, made = _counted(spark)
    M.grid_search(d.withColumn("fold", F.col("id") % 3), ["x"], "fold", [0.01, 1.0], 3)
    assert made.value == 400
    d, made = _counted(spark)
    assert Im.gate_by_year(d, ["y"], "yr", ["c"], ["x"]).count() == 1
    assert made.value == 400
    d, made = _counted(spark)
    folds = d.withColumn("fold", F.explode(F.array(F.lit(2002), F.lit(2003)))).withColumn("role", F.when(F.col("yr") < F.col("fold"), "train").otherwise("test"))
    tests, _ = M.fit_folds(folds, [2002, 2003], ["y"], ["x"])
    tests.count()
    assert made.value == 400


def test_calibration_rows_are_spread(spark, monkeypatch):
    parts = []
    fit = M.fit_grouped_logit
    monkeypatch.setattr(M, "fit_grouped_logit", lambda df, *a, **k: parts.append(df.rdd.getNumPartitions()) or fit(df, *a, **k))
    d, _ = _counted(spark)
    M.multi_output_logit(d.coalesce(1), ["x"], ["y"], ["id"])
    assert parts == [4]


def test_multi_output_reads_the_written_copy(spark):
    d, made = _counted(spark)
    assert M.multi_output_logit(d, ["x"], ["y"], ["id"]).count() == 400
    assert made.value == 400


def test_rows_of_a_label_are_not_moved_to_one_task(spark):
    d, _ = _counted(spark)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if no size were known
        plan = M.multi_output_logit(d, ["x"], ["y"], ["id"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert "Exchange hashpartitioning(label" not in plan and "SortMergeJoin" not in plan


def test_numbers_are_hashed_as_md5_does():
    for lead in (b"", b"8:r:1-URGENT:3:", b"x" * 53, b"y" * 80):
        numbers = np.array([0, 7, 9, 10, 99, 100, 12345, *range(990, 1010), 10**18 - 1, *range(20_000, 29_000)])
        assert H.hashed(lead, numbers).tolist() == [int(md5(lead + b"%d" % i).hexdigest()[:13], 16) for i in numbers.tolist()]


def test_weights_meet_rows_by_block(spark, monkeypatch):
    """Blocks that hold no draw among them; rows are never opened to replicates."""
    monkeypatch.setattr(S, "DRAWS_AT_ONCE", 70)
    monkeypatch.setattr(S, "WEIGHTS_AT_ONCE", 2)
    d = _table(spark)
    want = {(r.rep, r.caseid): r.weight for r in S.resample(d, ["g"], ["caseid"], 2, 5).collect()}
    made = S.with_weights(d, ["g"], ["caseid"], 2, 5, lambda t, w: pa.table({"caseid": t["caseid"], "w": pa.array(w.tolist(), pa.list_(pa.int64()))}), "caseid long, w array<long>")
    got = {r.caseid: r.w for r in made.collect()}
    assert len(got) == 300 and {(i + 1, c): v for c, w in got.items() for i, v in enumerate(w) if v} == want


def _no_copies(spark, monkeypatch):
    def refused(*_, **__):
        raise AssertionError("rows are opened to replicates")

    monkeypatch.setattr(I, "resample", refused)


def _auc(rows):
    """Weighted AUROC parts of (y, score, weight): won, pairs."""
    won = sum(w * v * (1.0 if s > r else 0.5 if s == r else 0.0) for y, s, w in rows for z, r, v in rows if y == 1 and z == 0)
    return won, sum(w for y, _, w in rows if y == 1) * sum(w for y, _, w in rows if y == 0)


def _odd(spark, n=90):
    """Labels, groups and scores that are missing or not a number, among ties."""
    return spark.createDataFrame([(i, "k" if i % 5 else "j", [None, "a", "b"][i % 3], [0, 1, -1, 1, 0, None, 1][i % 7], [float("nan"), 0.0, -0.0, None, 2.5][i * 7 % 5] if i % 4 else i * 13 % 11 / 2) for i in range(n)],
                                 "caseid long, m string, g string, y long, score double")


def test_exact_replicates_of_the_decomposition(spark, monkeypatch):
    d = _odd(spark)
    drawn = [r for r in S.resample(d, ["m", "y"], ["score", "caseid"], 6, 3).collect() if r.y in (0, 1) and r.score is not None]
    _no_copies(spark, monkeypatch)
    got = {(r.m, r.rep, r.tt): r.auc for r in B.decompose_exact(d, ["m"], "g", ["score", "caseid"], 6, 3).collect()}
    at = {True: np.inf}
    for m in ("j", "k"):
        for rep in range(1, 7):
            rows = [(r.y, at.get(r.score != r.score, r.score), r.weight, r.g) for r in drawn if (r.m, r.rep) == (m, rep)]
            won, pairs = _auc([r[:3] for r in rows])
            inner = [_auc([r[:3] for r in rows if r[3] == g]) for g in ("a", "b")]
            won_w, pairs_w = (sum(x) for x in zip(*inner))
            for tt, a, b in (("total", won, pairs), ("within", won_w, pairs_w), ("between", won - won_w, pairs - pairs_w)):
                assert got[m, rep, tt] == (pytest.approx(a / b) if b else None)
    assert len(got) == 2 * 6 * 3
    assert {r.tt for r in I.decompose_bootstrap(d, ["m"], "g", ["score", "caseid"], 6, 3).collect()} == {"total", "within", "between"}


def test_exact_replicates_of_two_scores(spark, monkeypatch):
    d = _odd(spark).withColumn("other", F.col("caseid") % 9)
    drawn = [r for r in S.resample(d, ["m"], ["caseid"], 6, 3).collect() if r.y in (0, 1)]
    _no_copies(spark, monkeypatch)
    got = {(r.m, r.which, r.rep): r.auc for r in B.auc_exact(d, ["m"], {"a": "score", "b": "other"}, ["caseid"], 6, 3).collect()}
    for (m, which, rep), value in got.items():
        rows = [(r.y, r["score" if which == "a" else "other"], r.weight) for r in drawn if (r.m, r.rep) == (m, rep)]
        won, pairs = _auc([(y, np.inf if s != s else s, w) for y, s, w in rows if s is not None])
        assert value == (pytest.approx(won / pairs) if pairs else None)
    assert len(got) == 2 * 2 * 6 and I.compare_bootstrap(d, ["m"], "score", "other", ["caseid"], 6, 3).count() == 6


def test_correlation_replicates_from_sums(spark, monkeypatch):
    d = spark.range(70).select(F.col("id").alias("caseid"), (F.col("id") % 2).cast("string").alias("k"), (F.col("id") * 7 % 13).alias("a"), (F.col("id") * 5 % 17).alias("b"))
    monkeypatch.setattr(S, "WEIGHTS_AT_ONCE", 60)
    drawn = S.resample(d, ["k"], ["caseid"], 4, 9, 2).collect()
    _no_copies(spark, monkeypatch)
    got = {(r.k, r.rep, r.sub): r.stat for r in I._corr_replicates(d, ["k"], "a", "b", ["caseid"], 4, 9, 2).collect()}
    for at, value in got.items():
        x, y, w = zip(*((r.a, r.b, r.weight) for r in drawn if (r.k, r.rep, r["sub"]) == at))
        c = np.cov(x, y, fweights=w)
        assert value == pytest.approx(c[0, 1] / np.sqrt(c[0, 0] * c[1, 1]))
    assert len(got) == 2 * 4 * 3


def test_an_equal_model_is_fitted_once(spark, monkeypatch, tmp_path):
    """Four periods, two settings: four fits to validate; of the stored models two were among them."""
    d, _ = _counted(spark)
    fitted, fit = [], Pi.fit_mixed
    monkeypatch.setattr(Pi, "fit_mixed", lambda df, *a, **k: fitted.append((df.agg(F.countDistinct("yr")).first()[0], k["c"])) or fit(df, *a, **k))
    fits = Pi.fit_periods(d, "yr", ["y"], ["x"], [], f"file://{tmp_path}", "logit", [{"c": 1.0}, {"c": 1e-7}], keep=["id"])
    assert len(fitted) == len(set(fitted)) == 6 and fits.models.count() == 4
    own = {r.id: r.preds for r in Pi.score_mixed(fit(d.filter("yr = 2000"), "logit", ["x"], [], "y", c=1.0), d.filter("yr = 2001")).collect()}
    assert {r.id: r.preds for r in fits.tests.filter("fold = 2001").collect()} == pytest.approx(own)
