"""Sorting, limits and set operations (sections 2.F and 2.G)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def sort_rows(df: DataFrame, order: list[Column]) -> DataFrame:
    """Total sort, for the edge of a plan."""
    return df.orderBy(*order)


def top_n(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The n first rows; the planner keeps n per task and merges."""
    return df.orderBy(*order).limit(n)


def stack(frames: dict[str, DataFrame], tag: str) -> DataFrame:
    """Union all with a source tag; absent columns become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True),
                  [df.withColumn(tag, F.lit(name)) for name, df in frames.items()])


def common_keys(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def except_keys(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)


def unique(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(*cols).distinct()


def union_keys(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def row_key(cols: list[str]) -> Column:
    """128-bit key of a row's content, NULL kept apart from text."""
    parts = [F.concat(F.lit("v"), F.to_json(F.struct(F.col(c).alias("c")), {"ignoreNullFields": "false"})) for c in cols]
    return F.md5(F.concat_ws("|", *parts))


def duplicates(df: DataFrame, ignore: list[str], out: str = "copies") -> DataFrame:
    """Every row whose content, less the ignored columns, occurs more than once.

    Counted with partial aggregation and joined back, so a content that fills a third of the table is
    never gathered in one task.
    """
    cols = [c for c in df.columns if c not in ignore]
    keyed = df.withColumn("_key", row_key(cols))
    repeated = keyed.groupBy("_key").agg(F.count(F.lit(1)).alias(out)).filter(F.col(out) > 1)
    return keyed.join(repeated, "_key").drop("_key")
