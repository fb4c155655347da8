"""Ranking inside many groups: hot and small ones at once, missing keys, and what moves over the network."""

import io
import random
from collections import defaultdict
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from cohortlens.operators import ordered as O, ranking as R
from cohortlens.plans import load, registry


def won(rows):
    """(positives, negatives, pairs won, a tie one half)."""
    pos, neg = [s for y, s in rows if y == 1], [s for y, s in rows if y == 0]
    return len(pos), len(neg), sum((a > b) + 0.5 * (a == b) for a in pos for b in neg)


def drawn(n, seed):
    """(period, group, y, score): one hot group, one hot score, missing periods, groups, labels and scores."""
    rnd = random.Random(seed)
    return [(rnd.choice([1, 2, None]), rnd.choice(["hot", "hot", "hot", None, *(f"g{i}" for i in range(40))]),
             rnd.choice([0, 1, 0, 1, -1, None]), rnd.choice([0.25, round(rnd.random(), 2), rnd.random(), None])) for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([("m", *r) for r in rows], "m string, yr long, g string, y long, score double")


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain()
    return out.getvalue()


@pytest.mark.parametrize("n,seed", [(40, 1), (900, 2)])
def test_groups_of_any_size(spark, n, seed):
    rows, by = drawn(n, seed), defaultdict(list)
    for _, g, y, s in rows:
        if g is not None and y in (0, 1) and s is not None:
            by[g].append((y, s))
    got = {r["g"]: r for r in R.auc_of_groups(R.labelled(frame(spark, rows), ["g"]), ["g"]).collect()}
    assert set(got) == set(by)
    for g, part in by.items():
        assert (got[g]["n1"], got[g]["n0"], got[g]["num"]) == won(part)


def test_all_periods_from_one_pass(spark):
    rows = [r for r in drawn(900, 3) if r[2] in (0, 1) and r[3] is not None]
    got = {(r["yr"], r["tt"]): r for r in R.decompose_all(frame(spark, rows), ["m"], "yr", "g").collect()}
    assert {k[0] for k in got} == {"1", "2", "all"}
    for at in ("1", "2", "all"):
        here, by = [r for r in rows if at == "all" or str(r[0]) == at], defaultdict(list)
        for _, g, y, s in here:
            by[g].append((y, s))
        n1, n0, num = won([(y, s) for _, _, y, s in here])
        inner = [won(v) for g, v in by.items() if g is not None]
        den_w, num_w = sum(a * b for a, b, _ in inner), sum(w for _, _, w in inner)
        assert (got[at, "total"]["n1"], got[at, "total"]["n0"]) == (n1, n0)
        for tt, (a, b) in {"total": (num, n1 * n0), "within": (num_w, den_w), "between": (num - num_w, n1 * n0 - den_w)}.items():
            assert got[at, tt]["den"] == b and got[at, tt]["auc"] == pytest.approx(a / b)


def test_crowded_keys_miss_no_large_group(spark):
    rows = spark.range(4000).select(F.when(F.col("id") < 1500, 0.0).when(F.col("id") < 2000, -0.0).otherwise(F.col("id").cast("double")).alias("k"))
    got = {r["k"]: r["c"] for r in rows.select("k", O.crowded_keys(rows, ["k"], 4).alias("c")).groupBy("k").agg(F.collect_set("c").alias("c")).collect()}
    assert got[0.0] == [True] and sum(True in c for c in got.values()) < 200 and all(len(c) == 1 for c in got.values())


def test_no_row_is_joined_to_what_buckets_hold(spark):
    df = frame(spark, drawn(300, 4))
    for out in (R.auc(df, ["g"]), R.auc_by_group(df, ["yr"], "g")):
        assert "Join" not in plan(out)


def test_small_groups_are_moved_once(spark):
    """The branch of whole groups has one exchange for its two grains, and none by score."""
    rows = R.labelled(frame(spark, drawn(300, 5)), ["m", "yr", "g"])
    whole = plan(R._won_inside(rows, ["m", "g"], "score", "yr"))
    assert whole.count("Exchange") == 1


def wide(spark, n, seed):
    """Cases with two labels and two scores; a hot group and missing values everywhere. Score c belongs to no row of label b."""
    rnd = random.Random(seed)
    rows = [(g, y, rnd.choice([0, 1, None]) if y else None, s, rnd.choice([0.5, rnd.random(), None]), None, rnd.randrange(3))
            for _, g, y, s in drawn(n, seed)]
    return spark.createDataFrame(rows, "g string, ya long, yb long, sa double, sb double, sc double, w long")


CELLS = [(("a", 1), "ya", "sa"), (("a", 2), "yb", "sa"), (("b", 1), "ya", "sb"), (("copy", 1), "ya", "sa"), (("none", 1), "yb", "sc")]


def opened(df, keys, cells, g):
    return df.select("*", F.explode(F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(keys, values)], F.col(y).alias("y"), F.col(s).alias("score"))
                                              for values, y, s in cells])).alias("_c")).select(g, *[c for c in ("w",) if c in df.columns], "_c.*")


@pytest.mark.parametrize("n,seed,weight", [(60, 6, None), (900, 7, None), (300, 8, "w")])
def test_cells_give_what_copied_rows_give(spark, n, seed, weight):
    df, keys = wide(spark, n, seed), ["model", "version"]

    def rows(out):
        return {(r["model"], r["version"], r["tt"]): (r["auc"], r["den"], r["n1"], r["n0"]) for r in out.collect()}

    got = rows(R.auc_decompose(df, keys, "g", weight=weight, cells=CELLS))
    want = rows(R.auc_decompose(opened(df, keys, CELLS, "g"), keys, "g", weight=weight))
    assert set(got) == set(want) and len(got) == 12
    for k, v in want.items():
        assert got[k][1:] == v[1:] and got[k][0] == pytest.approx(v[0])
    assert R.auc_decompose(df.limit(0), keys, "g", cells=CELLS).count() == 0


def test_cells_give_what_copied_rows_give_by_period(spark):
    df, keys = wide(spark, 600, 11).withColumn("yr", F.when(F.rand(5) < 0.9, F.floor(F.rand(3) * 3).cast("long"))).localCheckpoint(), ["model", "version"]

    def rows(out):
        return {(r["model"], r["version"], r["yr"], r["tt"]): (r["den"], r["n1"], r["n0"], r["auc"] and round(r["auc"], 9)) for r in out.collect()}

    both = df.select("yr", "g", *{c for _, y, s in CELLS for c in (y, s)})
    long = both.select("yr", F.posexplode(F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(keys, values)], "g", F.col(y).alias("y"), F.col(s).cast("double").alias("score"))
                                                    for values, y, s in CELLS])).alias("i", "_c")).select("yr", "_c.*")
    got = rows(R.decompose_all(both, keys, "yr", "g", cells=CELLS))
    assert got == rows(R.decompose_all(long, keys, "yr", "g")) and {k[2] for k in got} == {"0", "1", "2", "all"}
    assert R.decompose_all(both.limit(0), keys, "yr", "g", cells=CELLS).count() == 0


def lineitem(spark, n):
    rnd = random.Random(9)
    return spark.createDataFrame(
        [(rnd.randrange(5), float(rnd.randrange(1, 50)), rnd.choice([1e3, 2e4 * rnd.random(), None]), rnd.randrange(11) / 100, rnd.randrange(9) / 100,
          rnd.choice(["R", "A", None]), rnd.choice(["F", "O"]), f"199{rnd.randrange(5, 9)}-03-01") for _ in range(n)],
        "l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, d string"
    ).withColumn("l_shipdate", F.col("d").cast("timestamp"))


def test_wide_cases_are_those_of_multi(spark):
    def rows(df):
        return sorted((tuple(r) for r in df.select("model", "outcome", "version", "method", "test_year", "grp", "y", "preds").collect()), key=str)

    cases = registry.multi_wide(lambda _: lineitem(spark, 80))
    cells = [F.struct(*[F.lit(v).alias(k) for k, v in zip(registry.MULTI_KEYS, values)], F.col(y).alias("y"), F.col(s).alias("preds"))
             for values, y, s in registry.MULTI_CELLS]
    assert rows(cases.select("test_year", "grp", F.explode(F.array(*cells)).alias("c")).select("test_year", "grp", "c.*")) == \
        rows(registry.multi(lambda _: lineitem(spark, 80)))


def test_select_best_moves_a_case_once_for_each_score(spark, tmp_path):
    """Nine cells name two scores: cases are moved by score and group, never with the texts of a cell."""
    lineitem(spark, 200).write.parquet(str(tmp_path / "lineitem.parquet"))
    out = load()["select_best"].run(spark, str(tmp_path))
    moved = [x for x in plan(out).splitlines() if "Exchange hashpartitioning" in x]
    assert not [x for x in moved if "grp#" in x and "model#" in x] and [x for x in moved if "grp#" in x and "_of#" in x]
    assert out.count() == 2


def test_decompose_all_moves_a_case_once_for_each_score(spark, tmp_path):
    lineitem(spark, 200).write.parquet(str(tmp_path / "lineitem.parquet"))
    out = load()["decompose_all"].run(spark, str(tmp_path))
    moved = [x for x in plan(out).splitlines() if "Exchange hashpartitioning" in x]
    assert not [x for x in moved if "grp#" in x and "model#" in x] and [x for x in moved if "grp#" in x and "_of#" in x]
    assert out.count() == 9 * 5 * 3
