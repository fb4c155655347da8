"""Cleaning, joins, profiling, matching, sources."""

import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import clean as C, impute as Im, joins as J, match as N, profile as P, sets as Se
from cohortlens.sources import files as S


def test_binarise_minority(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(["yes"] * 2 + ["no"] * 5 + [None])], "id long, c string")
    assert [r["c"] for r in C.binarise_minority(df, ["c"]).orderBy("id").collect()] == [1, 1, 0, 0, 0, 0, 0, -1]


def test_composite_counts_missing_as_zero(spark):
    df = spark.createDataFrame([(1, -1), (0, -1), (0, 0), (0, None)], "a int, b int")
    got = C.composite(df, {"agg": ["a", "b"]}, flag_missing=True).collect()
    assert [r["agg"] for r in got] == [1, 0, 0, 0] and [r["agg_any_missing"] for r in got] == [1, 1, 0, 1]


def test_split_version(spark):
    df = spark.createDataFrame([("agg_wound2",), ("agg_renal",)], "code string")
    assert [(r["outcome"], r["version"]) for r in C.split_version(df, "code").collect()] == [("wound", 2), ("renal", 1)]


def test_range_join_case(spark):
    codes = spark.createDataFrame([(10010,), (10030,), (19499,)], "code int")
    ranges = spark.createDataFrame([(10000, 10022, "general"), (10040, 19499, "integumentary")], "lo int, hi int, cat string")
    got = {r["code"]: r["cat"] for r in J.range_join(codes, "code", ranges, "lo", "hi").collect()}
    assert got == {10010: "general", 10030: None, 19499: "integumentary"}


def test_dyadic_intervals(spark):
    """They are disjoint, make up the range, and are two for each level at most, to the ends of a bigint."""
    import random
    rnd = random.Random(3)
    ranges = [(a, a + w) for w in (0, 1, 2, 7, 1000, 10**9) for a in (0, 1, -5, 12345, -10**12)] + [(-2**63, 2**63 - 1), (2**63 - 1, 2**63 - 1), (-2**63, -2**63), (5, 4), (2**63 - 2, 2**63 - 1)]
    ranges += [(a, a + rnd.randrange(1 << 40)) for a in (rnd.randrange(-1 << 50, 1 << 50) for _ in range(30))]
    df = spark.createDataFrame(ranges, "lo long, hi long")
    for r in df.select("lo", "hi", J.dyadic(F.col("lo"), F.col("hi")).alias("d")).collect():
        spans = sorted((c.place << c.level, ((c.place + 1) << c.level) - 1) for c in r.d)
        assert len(spans) <= 2 * 64 and max([0, *[sum(c.level == k for c in r.d) for k in range(64)]]) <= 2
        if r.lo > r.hi:
            assert not spans
        else:
            assert spans[0][0] == r.lo and spans[-1][1] == r.hi and all(a[1] + 1 == b[0] for a, b in zip(spans, spans[1:]))


def test_range_join_odd_rows(spark):
    """NULL codes and bounds, empty and overlapping ranges, repeated codes, fractions, clashing names."""
    rows = [(1, 2.5), (2, None), (3, -0.5), (4, 2.5), (5, 7.0), (6, 1e6)]
    a = spark.createDataFrame(rows, "id long, code double").withColumn("level", F.lit("x"))
    held = [(2.4, 2.6, "narrow"), (2.6, 2.9, "beside"), (-1.0, 3.0, "wide"), (None, 5.0, "no lo"), (9.0, 1.0, "empty"), (7.0, 7.0, "point"), (-1e9, 1e9, "all")]
    r = spark.createDataFrame(held, "lo double, hi double, level string")
    got = sorted([tuple(x) for x in J.range_join(a, "code", r, "lo", "hi").collect()], key=str)
    want = []
    for i, c in rows:
        hits = [(lo, hi, n) for lo, hi, n in held if c is not None and lo is not None and lo <= c <= hi]
        want += [(i, c, "x", *h) for h in hits] or [(i, c, "x", None, None, None)]
    assert got == sorted(want, key=str)
    assert J.range_join(a.limit(0), "code", r, "lo", "hi").count() == 0
    assert J.range_join(a, "code", r.limit(0), "lo", "hi").filter("lo is null").count() == 6


def test_nearest_case(spark):
    q = spark.createDataFrame([(0, 1.0, 2.0)], "q long, a double, b double")
    r = spark.createDataFrame([(1, 1.0, 2.5), (2, 3.0, 2.0), (3, 0.0, 0.0)], "r long, a double, b double")
    got = N.nearest(q, r, ["a", "b"], [], "q", "r").first()
    assert (got["r"], got["err"]) == (1, 0.5)


@pytest.mark.parametrize("scale,offset", [(1.0, 0.0), (0.001, 5.0), (1e6, -5e5), (3.0, 1e9)])
def test_nearest_equals_brute_force(spark, scale, offset):
    import random
    rnd = random.Random(1)
    ref = [(i, rnd.random() * scale + offset, rnd.choice([0.0, 1.0, 2.0]) * scale, rnd.random() * scale) for i in range(150)]
    ref += [(900 + i, ref[0][1], ref[0][2], ref[0][3]) for i in range(5)]  # copies of one point
    qry = [(i, rnd.random() * 2 * scale + offset, rnd.random() * scale, rnd.random() * scale) for i in range(40)] + [(99, *ref[0][1:])]
    rs = spark.createDataFrame(ref, "r long, a double, b double, c double")
    qs = spark.createDataFrame(qry, "q long, a double, b double, c double")
    got = {r["q"]: r["err"] for r in N.nearest(qs, rs, ["a", "b", "c"], [], "q", "r").collect()}
    assert len(got) == len(qry)
    for q, *v in qry:
        want = min(sum(abs(x - y) for x, y in zip(v, r[1:])) for r in ref)
        assert got[q] == pytest.approx(want, abs=2e-9, rel=1e-9)


def test_duplicates_flag_every_copy(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([1, 2, 1, 1, 2, 3])], "id long, v long")
    assert sorted(r["id"] for r in Se.duplicates(df, ["id"]).collect()) == [0, 1, 2, 3, 4]
    pairs = N.duplicate_pairs(df, ["id"]).first()
    assert (pairs["rows"], pairs["pairs"]) == (5, 2)
    null_is_not_text = spark.createDataFrame([(1, None), (2, "null"), (3, "")], "id long, v string")
    assert Se.duplicates(null_is_not_text, ["id"]).count() == 0


def test_anova_case(spark):
    df = spark.createDataFrame([("v", "a", 1.0), ("v", "a", 2.0), ("v", "a", 3.0), ("v", "b", 4.0), ("v", "b", 6.0)], "v string, g string, x double")
    r = P.anova(df, ["v"], "g", "x").first()
    assert (r["ss_w"], r["ss_b"], r["f_stat"]) == pytest.approx((4.0, 10.8, 8.1))
    # with (1, 3) degrees of freedom the tail has this closed form through Student's t
    assert r["pval"] == pytest.approx(0.0653, abs=2e-3)


def test_missing_profile_in_one_job(spark):
    df = spark.createDataFrame([(1, None, 1.0), (1, "a", None), (2, "b", None)], "p int, x string, y double")
    got = {(r["name"], r["period"]): r["share"] for r in P.missing_profile(df, "p", ["x", "y"]).collect()}
    assert got == {("x", 1): 0.5, ("x", 2): 0.0, ("y", 1): 0.5, ("y", 2): 1.0}


def test_impute_mode_only_when_few(spark):
    df = spark.createDataFrame([(i, "a" if i < 15 else "b" if i < 18 else None, None if i % 2 else "z") for i in range(22)], "id long, few string, many string")
    out = Im.impute_mode(df, ["few", "many"])
    assert out.filter("few is null").count() == 0 and out.filter("many is null").count() == 11


def test_union_periods_drift(spark):
    a = spark.createDataFrame([(1, "5")], "ID long, Val string")
    b = spark.createDataFrame([(2, 6.0, "x")], "id long, val double, extra string")
    c = spark.createDataFrame([(3, 7.0)], "id long, val double")
    frames = [S.normalise_columns(f) for f in (a, b, c)]
    assert S.reconcile_schema(frames)["val"] == "double"
    got = {r["id"]: (r["val"], r["extra"]) for r in S.union_periods(frames).collect()}
    assert got == {1: (5.0, None), 2: (6.0, "x"), 3: (7.0, None)}


def test_reconcile_tie_takes_last_type_name(spark):
    a, b = spark.createDataFrame([("1",)], "v string"), spark.createDataFrame([(1,)], "v long")
    assert S.reconcile_schema([a, b])["v"] == "string"


def test_stata_files(spark, tmp_path):
    for yr in (2012, 2013):
        pd.DataFrame({"CASEID": [yr * 10 + i for i in range(3)], "sex": ["m", "f", "m"], "w": [1.5, 2.5, 3.5]}).to_stata(
            os.path.join(tmp_path, f"y{yr}.dta"), write_index=False)
    df = S.ingest_stata(spark, str(tmp_path), "caseid bigint, sex string, w double, absent string")
    assert df.count() == 6 and df.agg(F.sum("caseid")).first()[0] == sum(y * 10 + i for y in (2012, 2013) for i in range(3))
    assert df.filter("absent is not null").count() == 0


def test_materialise_follows_its_input(spark, tmp_path):
    src, root = str(tmp_path / "src"), str(tmp_path / "root")
    spark.range(5).write.parquet(src)
    count = lambda: S.materialise(root, "n", spark.read.parquet(src), lambda d: d.groupBy().count()).first()[0]
    assert count() == 5
    spark.range(7).write.mode("append").parquet(src)
    assert count() == 12


def test_materialise_follows_its_plan(spark, tmp_path):
    """An equal plan reuses; another filter, builder or parameter computes anew; a source without files is refused."""
    src, root = str(tmp_path / "src"), str(tmp_path / "root")
    spark.range(20).write.parquet(src)
    made = lambda build, *params, read=lambda: spark.read.parquet(src): sorted(S.materialise(root, "n", read(), build, *params).inputFiles())
    plain = made(lambda d: d.filter("id > 3"))
    assert made(lambda d: d.filter("id > 3")) == plain
    others = [made(lambda d: d.filter("id > 4")), made(lambda d: d.filter("id > 3").limit(5)), made(lambda d: d.filter("id > 3"), "v2"),
              made(lambda d: d.filter("id > 3"), read=lambda: spark.read.parquet(src).withColumn("x", F.lit(1)))]
    assert len({tuple(x) for x in [plain, *others]}) == 5
    with pytest.raises(ValueError, match="no files"):
        S.materialise(root, "n", spark.range(3), lambda d: d)


def test_contract_checks(spark):
    df = spark.createDataFrame([(1, "a"), (1, "x"), (None, "a")], "id long, c string")
    got = {r["rule"]: r["violations"] for r in S.check(df, ["id"], ["id"], {"c": ["a"]}, ["id"]).collect()}
    assert got == {"not_null:id": 1, "domain:c": 1, "unique:id": 1, "known_columns": 1}


def test_similar_pairs(spark):
    import random

    from cohortlens.operators.match import similar_pairs

    rng = random.Random(3)
    names = {"".join(rng.choice("abc ") for _ in range(rng.randint(0, 9))) for _ in range(150)} | {"xabcdefgh", "abcdefgh", "yabcdefgh", "abcdefghz"}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = _next(row, i, x, b)
        return row[-1]

    def _next(row, i, x, b):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        return new

    df = spark.createDataFrame([(n,) for n in sorted(names)] + [(None,)], "s string")
    for ratio in (0.5, 0.8):
        want = {(a, b) for a in names for b in names if a < b and a and 1 - distance(a, b) / max(len(a), len(b)) >= ratio - 1e-9}
        assert {(r.a, r.b) for r in similar_pairs(df, "s", ratio).collect()} == want
