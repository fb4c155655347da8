"""Bucketed scans: the same as plain windows, whatever the buckets; bounded buckets under ties."""

import random

import pytest
from pyspark.sql import Window as W, functions as F

from cohortlens.operators import ordered as O, windows as Wn


def noisy(spark, n=400, seed=3):
    rnd = random.Random(seed)
    data = [(i, "hot" if rnd.random() < 0.4 else rnd.choice("abc"), 5.0 if rnd.random() < 0.35 else round(rnd.random() * 10, 1),
             rnd.randint(1, 9) if rnd.random() < 0.8 else None) for i in range(n)]
    return spark.createDataFrame(data, "id long, k string, o double, v long")


@pytest.mark.parametrize("buckets", [1, 2, 7, 70, 200])
def test_scan_equals_window(spark, rows, buckets):
    df = noisy(spark)
    w = W.partitionBy("k").orderBy("o", "id").rowsBetween(W.unboundedPreceding, 0)
    want = df.select("id", F.sum("v").over(w).alias("s"), F.count(F.lit(1)).over(w).alias("c"), F.min("v").over(w).alias("lo"),
                     F.max("v").over(w).alias("hi"), F.last("v", True).over(w).alias("l"))
    want = want.withColumn("s", F.coalesce("s", F.lit(0)))
    got = O.scan(df, ["k"], ["o", "id"], {"s": ("sum", "v"), "c": ("count", None), "lo": ("min", "v"), "hi": ("max", "v"), "l": ("last", "v")},
                 buckets=buckets)
    assert rows(got.select("id", "s", "c", "lo", "hi", "l")) == rows(want)


@pytest.mark.parametrize("buckets", [1, 5, 70])
def test_reverse_and_exclusive(spark, rows, buckets):
    df = noisy(spark, seed=4)
    w = W.partitionBy("k").orderBy(F.desc("o"), F.desc("id")).rowsBetween(W.unboundedPreceding, -1)
    want = df.select("id", F.coalesce(F.sum("v").over(w), F.lit(0)).alias("s"), F.last("v", True).over(w).alias("l"))
    got = O.scan(df, ["k"], ["o", "id"], {"s": ("sum", "v"), "l": ("last", "v")}, reverse=True, exclusive=True, buckets=buckets)
    assert rows(got.select("id", "s", "l")) == rows(want)


def test_global_numbering_and_text_order(spark, rows):
    df = noisy(spark).select("id", F.concat(F.col("k"), F.col("id").cast("string")).alias("name"))
    want = df.select("id", F.row_number().over(W.orderBy("name")).alias("rn"))
    got = O.number_rows(df, [], ["name"], buckets=6)
    assert rows(got.select("id", F.col("rn").cast("int"))) == rows(want)


def test_text_with_a_long_common_prefix_is_spread(spark):
    df = spark.range(3000).select("id", F.concat(F.lit("Customer#"), F.lpad(F.col("id").cast("string"), 12, "0")).alias("name"))
    data, cols = O.with_buckets(df, ["name"], 8)
    assert data.groupBy(*cols).count().agg(F.max("count")).first()[0] < 3000 / 3
    hot = df.withColumn("name", F.when(F.col("id") % 3 != 0, "same").otherwise(F.col("name")))
    data, cols = O.with_buckets(hot, ["name", "id"], 8)
    assert data.groupBy(*cols).count().agg(F.max("count")).first()[0] < 3000 / 3


def test_date_and_timestamp_orders(spark, rows):
    df = spark.range(200).select("id", F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 17).cast("int")).alias("d"))
    df = df.withColumn("t", F.col("d").cast("timestamp_ntz"))
    for c in ("d", "t"):
        want = df.select("id", F.row_number().over(W.orderBy(c, "id")).cast("bigint").alias("rn"))
        assert rows(O.number_rows(df.select("id", c), [], [c, "id"], buckets=5).select("id", "rn")) == rows(want)


def test_hot_value_is_split_by_the_next_column(spark):
    """A value that fills most rows must not end up in one bucket."""
    df = spark.range(4000).select("id", F.when(F.col("id") % 10 < 7, 1.0).otherwise(F.col("id") / 7.0).alias("o"))
    data, cols = O.with_buckets(df, ["o", "id"], 8)
    largest = data.groupBy(*cols).count().agg(F.max("count")).first()[0]
    assert largest <= 2 * 4000 / 8


def test_lag_keeps_nulls(spark, rows):
    df = noisy(spark, seed=8)
    w = W.partitionBy("k").orderBy("o", "id")
    want = df.select("id", F.lag("v").over(w).alias("p"))
    assert rows(O.lag_value(df, ["k"], ["o", "id"], "v", "p", buckets=9).select("id", "p")) == rows(want)


@pytest.mark.parametrize("block", [10, 33, 100_000])
def test_rolling_across_blocks(spark, rows, block):
    df = noisy(spark, seed=9).fillna({"v": 0})
    w = W.partitionBy("k").orderBy("o", "id").rowsBetween(-4, 3)
    want = df.select("id", F.when(F.count(F.lit(1)).over(w) == 8, F.round(F.avg("v").over(w), 9)).alias("m"))
    got = O.rolling(df, ["k"], ["o", "id"], {"m": (F.avg("v"), 4, 3)}, block_rows=block)
    assert rows(got.select("id", F.round("m", 9))) == rows(want)


def test_fill_edges(spark, rows):
    df = spark.createDataFrame([(i, "x", v) for i, v in enumerate([None, None, 3, None, 5, None, None])], "id long, k string, v long")
    got = sorted((r["id"], r["v"]) for r in O.fill_edges(df, ["k"], ["id"], ["v"]).collect())
    assert [v for _, v in got] == [3, 3, 3, 5, 5, 5, 5]


def test_quantiles_equal_interpolation(spark):
    df = noisy(spark, seed=10)
    probs = [0.0, 0.1, 0.333, 0.5, 0.975, 1.0]
    got = {(r["k"], r["p"]): r["q"] for r in O.exact_quantiles(df, ["k"], "o", probs).collect()}
    want = df.groupBy("k").agg(F.percentile("o", F.array(*map(F.lit, probs))).alias("q")).collect()
    for r in want:
        for p, q in zip(probs, r["q"]):
            assert got[(r["k"], p)] == pytest.approx(q)


def test_weighted_quantiles_equal_copies(spark):
    df = spark.createDataFrame([("a", float(i), i % 4) for i in range(30)], "k string, v double, w int")
    got = O.quantile_columns(df, ["k"], "v", {"q": 0.37}, weight="w").first()["q"]
    copies = df.select("k", F.explode(F.array_repeat("v", F.col("w"))).alias("v"))
    assert got == pytest.approx(copies.agg(F.percentile("v", 0.37)).first()[0])


def test_quintile_edges(spark):
    df = spark.createDataFrame([(str(i), i / 10) for i in range(1, 11)], "g string, r double")
    got = {r["g"]: r["bin"] for r in Wn.quantile_bins(df, "g", "r", 5).collect()}
    assert [got[str(i)] for i in range(1, 11)] == [0, 0, 1, 1, 2, 2, 3, 3, 4, 4]


def test_quantile_bins_keep_null_values(spark):
    df = spark.createDataFrame([(i, float(i) if i % 4 else None) for i in range(1, 21)], "g int, r double")
    got = {r["g"]: r["bin"] for r in Wn.quantile_bins(df, "g", "r", 5).collect()}
    assert len(got) == 20 and {g for g, b in got.items() if b is None} == {4, 8, 12, 16, 20} and {b for b in got.values() if b is not None} == set(range(5))


def test_quantile_bins_reject_duplicate_edges(spark):
    df = spark.createDataFrame([(str(i), 1.0) for i in range(5)], "g string, r double")
    with pytest.raises(Exception, match="duplicate bin edges"):
        Wn.quantile_bins(df, "g", "r", 5).collect()


def test_last_run(spark):
    df = spark.createDataFrame(list(enumerate([0, 1, 0, 1, 1, 0, 1, 1], 1)), "d long, f int")
    assert Wn.last_run_start(df, [], ["d"], F.col("f") == 1).first()["d"] == 7
    none = Wn.last_run_start(df, [], ["d"], F.col("f") == 9)
    assert none.collect() == []
