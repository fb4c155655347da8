"""Aggregations and reshaping (section 2.D)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.dist import f_sf
from .ordered import quantile_columns, scan
from .ranking import div

CHUNK = 100  # aggregates per projection; keeps generated code within the JVM's method limit


def summarise(df: DataFrame, keys: list[str], specs: dict[str, Column]) -> DataFrame:
    return df.groupBy(*keys).agg(*[e.alias(n) for n, e in specs.items()])


def weighted_mean(x: str, w: str) -> Column:
    return div(F.sum(F.col(x) * F.col(w)), F.sum(F.when(F.col(x).isNotNull(), F.col(w))))


def missing_profile(df: DataFrame, period: str, cols: list[str]) -> DataFrame:
    """Missing share of each column by period: name, period, share. One job for all columns."""
    parts = []
    for i in range(0, len(cols), CHUNK):
        chunk = cols[i:i + CHUNK]
        wide = df.groupBy(F.col(period).alias("period")).agg(
            *[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in chunk])
        parts.append(wide.unpivot(["period"], chunk, "name", "share"))
    return reduce(DataFrame.unionByName, parts).select("name", "period", "share")


def missing_overall(profile: DataFrame, sizes: DataFrame) -> DataFrame:
    """Missing share over all periods, weighted by their sizes."""
    return profile.join(sizes, "period").groupBy("name").agg(
        div(F.sum(F.col("share") * F.col("n")), F.sum("n")).alias("share"))


def missing_swing(profile: DataFrame) -> DataFrame:
    """Largest minus smallest missing share between periods."""
    return profile.groupBy("name").agg((F.max("share") - F.min("share")).alias("swing"))


def column_stats(df: DataFrame, cols: list[str], approx: bool = False) -> DataFrame:
    """Distinct and missing values per column: name, n_distinct, n_missing.

    Exact counts group (name, value) pairs, so the work spreads over the values and partial
    aggregation thins hot values; ``approx`` uses one HyperLogLog pass.
    """
    if approx:
        wide = df.agg(*[F.struct(F.approx_count_distinct(c).alias("n_distinct"),
                                 F.sum(F.col(c).isNull().cast("bigint")).alias("n_missing")).alias(c) for c in cols])
        return wide.unpivot([], cols, "name", "_s").select("name", "_s.*")
    text = df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot([], cols, "name", "value")
    counts = text.groupBy("name", "value").agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy("name").agg(
        F.count("value").alias("n_distinct"),
        F.sum(F.when(F.col("value").isNull(), F.col("_n")).otherwise(0)).alias("n_missing"))


def crosstab(df: DataFrame, row: str, col: str, values: list, normalise: bool = True) -> DataFrame:
    """Counts (or row shares) of ``col`` values by ``row``, wide."""
    counts = df.groupBy(row).pivot(col, values).count()
    cells = [F.coalesce(F.col(str(v)), F.lit(0)) for v in values]
    if not normalise:
        return counts.select(row, *[c.alias(str(v)) for c, v in zip(cells, values)])
    total = reduce(lambda a, b: a + b, cells)
    return counts.select(row, *[div(c, total).alias(str(v)) for c, v in zip(cells, values)])


def wide(df: DataFrame, keys: list[str], col: str, values: list, agg: Column, fill=0) -> DataFrame:
    """Long to wide with the values given, so no extra job looks for them; NULL filled."""
    out = df.groupBy(*keys).pivot(col, values).agg(agg)
    return out.select(*keys, *[F.coalesce(F.col(str(v)), F.lit(fill)).alias(str(v)) for v in values])


def long(df: DataFrame, ids: list[str], values: list[str], name: str = "name", value: str = "value") -> DataFrame:
    return df.unpivot(ids, values, name, value)


def level_share(df: DataFrame, keys: list[str], level: str) -> DataFrame:
    """n and share of each level within keys (levels are few after the count)."""
    counts = df.groupBy(*keys, level).agg(F.count(F.lit(1)).alias("n"))
    if not keys:
        tot = counts.agg(F.sum("n")).scalar()
        return counts.withColumn("share", div(F.col("n"), tot))
    totals = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_tot"))
    return counts.join(totals, keys).select(*keys, level, "n", div(F.col("n"), F.col("_tot")).alias("share"))


def mode_of(df: DataFrame, cols: list[str]) -> DataFrame:
    """Most frequent non-null value per column (as text): name, mode, n; ties: smallest value."""
    text = df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot([], cols, "name", "value")
    counts = text.filter(F.col("value").isNotNull()).groupBy("name", "value").agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("o"), F.col("value"), F.col("n")))
    return counts.groupBy("name").agg(best.alias("_b")).select(
        "name", F.col("_b.value").alias("mode"), F.col("_b.n").alias("n"))


def event_rate(df: DataFrame, keys: list[str], y: str = "y") -> DataFrame:
    """Share of events among known labels."""
    return df.filter(F.col(y).isin(0, 1)).groupBy(*keys).agg(
        F.avg(F.col(y).cast("double")).alias("rate"), F.count(F.lit(1)).alias("n"))


def event_counts(df: DataFrame, keys: list[str], labels: list[str]) -> DataFrame:
    """Events by keys and label, long: keys, label, events."""
    sums = df.groupBy(*keys).agg(*[F.sum((F.col(c) == 1).cast("bigint")).alias(c) for c in labels])
    return sums.unpivot(keys, labels, "label", "events")


def frequent(df: DataFrame, key: str, min_n: int) -> DataFrame:
    """Keys with more than ``min_n`` rows."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > min_n)


def share_with_event(df: DataFrame, keys: list[str], g: str, y: str = "y") -> DataFrame:
    """Share of groups that have at least one event."""
    per = df.groupBy(*keys, g).agg(F.max((F.col(y) == 1).cast("int")).alias("_any"))
    return per.groupBy(*keys).agg(F.avg(F.col("_any").cast("double")).alias("share"), F.count(F.lit(1)).alias("groups"))


def label_patterns(df: DataFrame, labels: list[str]) -> DataFrame:
    """Co-occurrence patterns of labels with their share."""
    counts = df.groupBy(*labels).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", div(F.col("n"), counts.agg(F.sum("n")).scalar()))


def uniqueness(df: DataFrame, a: str, b: str) -> DataFrame:
    """Does a value of ``b`` belong to one ``a`` only? joint and marginal counts per pair."""
    joint = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n_ab"))
    by_b = joint.groupBy(b).agg(F.sum("n_ab").alias("n_b"))
    return joint.join(by_b, b).select(a, b, "n_ab", "n_b", (F.col("n_ab") == F.col("n_b")).cast("int").alias("is_unique"))


def column_presence(frames: dict[str, DataFrame]) -> DataFrame:
    """Which columns each extract has: column, n_extracts, pattern ('1' present, '0' absent).

    Schemas are metadata of the plan: no data is read.
    """
    spark = next(iter(frames.values())).sparkSession
    tags = sorted(frames)
    names = sorted({c for df in frames.values() for c in df.columns})
    rows = [(c, sum(c in frames[k].columns for k in tags), "".join("1" if c in frames[k].columns else "0" for k in tags))
            for c in names]
    return spark.createDataFrame(rows, "column string, n_extracts int, pattern string")


def share_variance(df: DataFrame, period: str, level: str) -> DataFrame:
    """Variance over periods of each level's share."""
    return level_share(df, [period], level).groupBy(level).agg(
        F.var_samp("share").alias("var_share"), F.avg("share").alias("mean_share"))


def anova(df: DataFrame, var: list[str], g: str, value: str, with_p: bool = True) -> DataFrame:
    """Within and between sums of squares with the F statistic, from cell moments.

    Sums are taken around the variable's mean, which keeps the subtraction exact enough.
    """
    mu = df.groupBy(*var).agg(F.avg(value).alias("_mu"))
    d = F.col(value) - F.col("_mu")
    cells = df.join(mu, var).groupBy(*var, g).agg(
        F.count(value).alias("_n"), F.sum(d).alias("_s"), F.sum(d * d).alias("_q"))
    out = cells.groupBy(*var).agg(
        F.sum(F.col("_q") - F.col("_s") ** 2 / F.col("_n")).alias("ss_w"),
        F.sum(F.col("_s") ** 2 / F.col("_n")).alias("ss_b"),
        F.sum("_n").alias("n"), F.count(F.lit(1)).alias("k"))
    out = out.withColumn("dof_b", F.col("k") - 1).withColumn("dof_w", F.col("n") - F.col("k"))
    out = out.withColumn("f_stat", div(div(F.col("ss_b"), F.col("dof_b")), div(F.col("ss_w"), F.col("dof_w"))))
    return out.withColumn("pval", f_sf("f_stat", "dof_b", "dof_w")) if with_p else out


def correlate(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.corr(a, b).alias("rho"))


def spread_summary(df: DataFrame, keys: list[str], col: str) -> DataFrame:
    """25%, mean and 75% in long form: keys, stat, value."""
    q = quantile_columns(df, keys, col, {"q25": 0.25, "q75": 0.75})
    m = df.groupBy(*keys).agg(F.avg(col).alias("mean"))
    return q.join(m, keys).unpivot(keys, ["q25", "mean", "q75"], "stat", "value")


def counts_above(df: DataFrame, keys: list[str], col: str, cuts: list[float]) -> DataFrame:
    """Rows at or above each cut, and their share: keys, cut, n, share."""
    agg = df.groupBy(*keys).agg(F.count(col).alias("_tot"), *[
        F.sum((F.col(col) >= c).cast("bigint")).alias(f"_c{i}") for i, c in enumerate(cuts)])
    cells = F.explode(F.array(*[F.struct(F.lit(float(c)).alias("cut"), F.col(f"_c{i}").alias("n"))
                                for i, c in enumerate(cuts)])).alias("_x")
    return agg.select(*keys, "_tot", cells).select(
        *keys, F.col("_x.cut").alias("cut"), F.col("_x.n").alias("n"), div(F.col("_x.n"), F.col("_tot")).alias("share"))


def expected_vs_observed(df: DataFrame, keys: list[str], y: str, preds: list[str]) -> DataFrame:
    """Events beside the sum of each prediction, long: keys, mdl, total, diff (observed - predicted)."""
    sums = df.groupBy(*keys).agg(F.sum(F.col(y).cast("double")).alias("_y"), *[F.sum(F.col(p).cast("double")).alias(p) for p in preds])
    return sums.unpivot([*keys, "_y"], preds, "mdl", "total").select(
        *keys, "mdl", "total", (F.col("_y") - F.col("total")).alias("diff"))


def pareto(df: DataFrame, keys: list[str], level: str) -> DataFrame:
    """Cumulative share of levels in descending frequency: rank, n, cum_share; ties by level."""
    counts = df.groupBy(*keys, level).agg(F.count(F.lit(1)).alias("n")).withColumn("_o", -F.col("n"))
    out = scan(counts, keys, ["_o", level], {"rank": ("count", None), "_c": ("sum", "n")}, totals={"_t": "n"})
    return out.select(*keys, level, "n", "rank", div(F.col("_c"), F.col("_t")).alias("cum_share"))
