"""Dictionaries of any number of levels, and sparse one-hot rows."""

import pytest
from pyspark.sql import functions as F

from cohortlens.operators import features as K


def test_dictionary_numbers_levels_in_order(spark):
    df = spark.createDataFrame([("b", 2, 1), ("a", 2, 2), ("b", 10, 3), (None, 10, 4), ("b", None, 5)], "g string, k int, id long")
    got = [tuple(r) for r in K.level_dictionary(df, ["k", "g"]).orderBy("pos").collect()]
    assert got == [("g", "a", 1, 0), ("g", "b", 3, 1), ("k", "10", 2, 2), ("k", "2", 2, 3)]
    kept = [tuple(r) for r in K.level_dictionary(df, ["k", "g"], keep=1).orderBy("pos").collect()]
    assert kept == [("g", "b", 3, 0), ("k", "10", 2, 1)]
    dropped = [tuple(r)[:2] for r in K.level_dictionary(df, ["k", "g"], drop_mode=True).orderBy("pos").collect()]
    assert dropped == [("g", "a"), ("k", "2")]
    assert K.level_dictionary(df.limit(0), ["g"]).count() == 0


def test_sparse_rows(spark):
    train = spark.createDataFrame([("a", "x"), ("b", "y"), ("b", "x")], "g string, h string")
    d = K.level_dictionary(train, ["g", "h"])
    df = spark.createDataFrame([(1, "b", "x"), (2, "new", "y"), (3, None, None), (4, "a", None), (4, "a", None), (None, "a", "x")], "id long, g string, h string").withColumn("pos", F.lit(9))
    got = {r.id: list(r.positions) for r in K.sparse_code(df, "id", ["g", "h"], d).collect()}
    assert got == {1: [1, 2], 2: [3], 3: [], 4: [0], None: [0, 2]}
    assert K.sparse_code(df.limit(0), "id", ["g"], d).count() == 0


def test_many_levels_are_not_collected(spark):
    df = spark.range(300_000).select(F.col("id"), F.concat(F.lit("v"), F.col("id")).alias("g"), F.lit("hot").alias("h"))
    d = K.level_dictionary(df, ["g", "h"])
    assert d.count() == 300_001 and d.agg(F.max("pos"), F.countDistinct("pos")).first() == (300_000, 300_001)
    whole = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    by_task = d.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", whole)
    assert by_task < 150_000
    with pytest.raises(ValueError, match="levels"):
        K.training_levels(df, ["g"])
    assert K.training_levels(df, ["h"]) == {"h": ["hot"]}
