"""Joins (section 2.C). No operator builds all pairs of a group; small sides are left to the size-based
broadcast of the planner, so nothing is forced into every executor's memory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.draws import draw_index
from .draws import spread_draws
from .ordered import number_rows, scan


def join_on(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    return a.join(b, on=keys, how=how)


def shared_columns(a: DataFrame, b: DataFrame) -> list[str]:
    return [c for c in a.columns if c in b.columns]


def natural_join(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    """Equi join on every shared column; shared_columns(a, b) tells which."""
    keys = shared_columns(a, b)
    if not keys:
        raise ValueError("no shared columns")
    return a.join(b, on=keys, how=how)


def semi(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.join(b.select(*keys), on=keys, how="left_semi")


def anti(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.join(b.select(*keys), on=keys, how="left_anti")


def dyadic(lo: Column, hi: Column) -> Column:
    """Array of (level, place): the fewest intervals [place * 2^level, (place + 1) * 2^level) that make up the integers lo .. hi,
    two for each level at most; empty where lo > hi or a bound is NULL."""
    state = "struct<l: bigint, r: bigint, out: array<struct<level: int, place: bigint>>>"
    start = F.struct(lo.cast("bigint").alias("l"), hi.cast("bigint").alias("r"), F.array().cast("array<struct<level: int, place: bigint>>").alias("out")).cast(state)

    def climb(a: Column, k: Column) -> Column:
        l, r = a["l"], a["r"]
        cell = lambda place: F.struct(k.cast("int").alias("level"), place.alias("place"))
        odd, even = l.bitwiseAND(F.lit(1)) == 1, r.bitwiseAND(F.lit(1)) == 0
        last = F.struct(F.lit(1).cast("bigint").alias("l"), F.lit(0).cast("bigint").alias("r"), F.concat(a["out"], F.array(cell(l))).alias("out"))
        more = F.concat(a["out"], F.filter(F.array(F.when(odd, cell(l)), F.when(even, cell(r))), lambda x: x.isNotNull()))
        inner_l, inner_r = F.when(odd, l + 1).otherwise(l), F.when(even, r - 1).otherwise(r)
        ended = inner_l > inner_r  # stop as an empty interval, whatever halving would make of it
        step = F.struct(F.when(ended, F.lit(1)).otherwise(F.shiftright(inner_l, 1)).cast("bigint").alias("l"),
                        F.when(ended, F.lit(0)).otherwise(F.shiftright(inner_r, 1)).cast("bigint").alias("r"), more.alias("out"))
        return F.when(l > r, a).when(l == r, last).otherwise(step).cast(state)

    whole = F.aggregate(F.sequence(F.lit(0), F.lit(63)), start, climb, lambda a: a["out"])
    return F.when(lo.isNotNull() & hi.isNotNull(), whole)


def range_join(a: DataFrame, code: str, ranges: DataFrame, lo: str, hi: str) -> DataFrame:
    """Left outer join of codes to the ranges [lo, hi] that hold them: an equi join whatever the widths.

    A range is listed by its dyadic intervals, at most two for each level; a distinct code looks up the one interval that
    holds it on each level that occurs among the ranges. Numbers with fractions meet on their floors and are compared then.
    Rows with a NULL code, or one in no range, stay with NULLs; ranges with a NULL bound or lo > hi hold nothing.
    """
    own = F.struct(*[F.col(f"`{c}`") for c in ranges.columns]).alias("_range")
    cells = ranges.select(own, F.inline(dyadic(F.floor(F.col(f"`{lo}`")), F.floor(F.col(f"`{hi}`")))))
    levels = cells.agg(F.array_sort(F.collect_set("level"))).scalar()
    codes = a.select(F.col(f"`{code}`").alias("_code")).filter(F.col("_code").isNotNull()).distinct()
    probes = codes.withColumn("level", F.explode(levels)).withColumn("_cell", F.floor("_code")).withColumn("place", F.expr("shiftright(_cell, level)"))
    hits = probes.join(cells, ["level", "place"]).filter(F.col("_code").between(F.col("_range")[lo], F.col("_range")[hi])).select("_code", "_range")
    kept = F.struct(*[F.col(f"`{c}`") for c in a.columns]).alias("_row")
    out = a.select(kept, F.col(f"`{code}`").alias("_at")).join(hits, F.col("_at") == F.col("_code"), "left")
    return out.select(*[F.col("_row")[c].alias(c) for c in a.columns], *[F.col("_range")[c].alias(c) for c in ranges.columns])


def join_by_position(a: DataFrame, b: DataFrame, keys: list[str], order_a: list[str], order_b: list[str]) -> DataFrame:
    """Pair the i-th row of a with the i-th row of b inside keys."""
    left = number_rows(a, keys, order_a, "_pos")
    right = number_rows(b, keys, order_b, "_pos")
    return left.join(right, on=[*keys, "_pos"]).drop("_pos")


def join_replicates(a: DataFrame, b: DataFrame, keys: list[str], rep: str = "rep") -> DataFrame:
    """Pair replicates by their id; replicates missing on one side are left out."""
    return a.join(b, on=[*keys, rep])


def with_group_agg(df: DataFrame, keys: list[str], aggs: dict[str, Column]) -> DataFrame:
    """Group aggregates on every row. A join back, not a window: a window would hold a whole group in
    one task, while the join can be split (adaptive skew join) or broadcast by size. Rows with a NULL
    key keep their columns and have NULL aggregates."""
    summary = df.groupBy(*keys).agg(*[e.alias(n) for n, e in aggs.items()])
    return df.join(summary, on=keys, how="left")


def sample_pairs(df: DataFrame, keys: list[str], n: int, seed: int, id_col: str, y: str = "y") -> DataFrame:
    """``n`` drawn (positive, negative) pairs per keys: keys, i, id1, id0. A key's draws are spread over tasks."""
    rows = number_rows(df.filter(F.col(y).isin(0, 1)).select(*keys, y, id_col), [*keys, y], [id_col], "_pos")
    size = df.groupBy(*keys).agg(F.sum((F.col(y) == 1).cast("bigint")).alias("n1"),
                                 F.sum((F.col(y) == 0).cast("bigint")).alias("n0"))
    draws = (spread_draws(size.filter((F.col("n1") > 0) & (F.col("n0") > 0)), keys, n)
             .withColumn("_p1", draw_index(F.col("n1"), seed, 1, *[F.col(k) for k in keys], F.col("i")) + 1)
             .withColumn("_p0", draw_index(F.col("n0"), seed, 0, *[F.col(k) for k in keys], F.col("i")) + 1))
    pos = rows.filter(F.col(y) == 1).select(*keys, F.col("_pos").alias("_p1"), F.col(id_col).alias("id1"))
    neg = rows.filter(F.col(y) == 0).select(*keys, F.col("_pos").alias("_p0"), F.col(id_col).alias("id0"))
    return draws.join(pos, [*keys, "_p1"]).join(neg, [*keys, "_p0"]).select(*keys, "i", "id1", "id0")


def running_count(df: DataFrame, date: str, out: str = "n") -> DataFrame:
    """For each date the number of rows dated on or before it."""
    daily = df.groupBy(date).agg(F.count(F.lit(1)).alias("_n"))
    return scan(daily, [], [date], {out: ("sum", "_n")}).drop("_n")


def column_pairs(df: DataFrame, id_col: str, cols: list[str]) -> DataFrame:
    """Every ordered pair of columns on the same row, both present: id, cn1, cn2, v1, v2."""
    cells = F.array(*[F.struct(F.lit(a).alias("cn1"), F.lit(b).alias("cn2"), F.col(a).cast("double").alias("v1"),
                               F.col(b).cast("double").alias("v2")) for a in cols for b in cols])
    return (df.select(id_col, F.explode(cells).alias("_c")).select(id_col, "_c.*")
            .filter(F.col("v1").isNotNull() & F.col("v2").isNotNull()))


def key_overlap(df: DataFrame, period: str, key: str) -> DataFrame:
    """Number of keys two periods share: p1, p2, n. A key carries at most one entry per period."""
    sets = df.select(period, key).distinct().groupBy(key).agg(F.collect_set(period).alias("_p"))
    return (sets.select(F.explode("_p").alias("p1"), "_p").select("p1", F.explode("_p").alias("p2"))
            .groupBy("p1", "p2").agg(F.count(F.lit(1)).alias("n")))
