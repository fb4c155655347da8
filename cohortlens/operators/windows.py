"""Window-style operators (section 2.E), built on the bucketed scans so hot keys do not matter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .ordered import fill_edges, lag_value, number_rows, quantile_columns, rolling, scan
from .ranking import div


def running_number(df: DataFrame, keys: list[str], order: list[str], out: str = "rn") -> DataFrame:
    return number_rows(df, keys, order, out)


def cumulate(df: DataFrame, keys: list[str], order: list[str], cols: list[str]) -> DataFrame:
    """Running sums <col>_end and the running sum before the row <col>_start."""
    out = scan(df, keys, order, {f"{c}_end": ("sum", c) for c in cols})
    return out.select("*", *[(F.col(f"{c}_end") - F.coalesce(F.col(c), F.lit(0))).alias(f"{c}_start") for c in cols])


def lag_diff(df: DataFrame, keys: list[str], order: list[str], col: str, out: str = "diff") -> DataFrame:
    """Difference to the row before; NULL on the first row."""
    return lag_value(df, keys, order, col, "_lag").withColumn(out, F.col(col) - F.col("_lag")).drop("_lag")


def _centred(col: str, k: int) -> dict:
    """Frames of a centred mean over k rows and sd over 2k rows; even windows reach one further back."""
    return {"mu": (F.avg(col), k // 2, k - k // 2 - 1), "se": (F.stddev_samp(col), k, k - 1)}


def rolling_stats(df: DataFrame, keys: list[str], order: list[str], col: str, k: int) -> DataFrame:
    """Centred mean over k rows and sample sd over 2k rows; NULL unless the frame is full of values."""
    return rolling(df, keys, order, _centred(col, k), of=col)


def rolling_filled(df: DataFrame, keys: list[str], order: list[str], col: str, k: int) -> DataFrame:
    """rolling_stats with incomplete windows filled from the nearest complete one."""
    stats = rolling(df, keys, order, _centred(col, k), keep_block=True, of=col)
    return fill_edges(stats, keys, ["_pos"], ["mu", "se"], block="_block").drop("_pos", "_block")


def rolling_outliers(df: DataFrame, keys: list[str], order: list[str], col: str, k: int, width: Column) -> DataFrame:
    """Flag values outside mean +/- width * sd of the rolling statistics and set them to NULL."""
    stats = rolling_filled(df, keys, order, col, k)
    far = (F.col(col) > F.col("mu") + width * F.col("se")) | (F.col(col) < F.col("mu") - width * F.col("se"))
    return (stats.withColumn("outlier", F.coalesce(far, F.lit(False)).cast("int"))
            .withColumn("kept", F.when(F.col("outlier") == 0, F.col(col))))


def midrank(df: DataFrame, keys: list[str], col: str, out: str = "rank") -> DataFrame:
    """Average rank of ties; NULL values get no rank."""
    hist = df.filter(F.col(col).isNotNull()).groupBy(*keys, col).agg(F.count(F.lit(1)).alias("_n"))
    ranked = scan(hist, keys, [col], {"_before": ("sum", "_n")}, exclusive=True)
    ranks = ranked.select(*keys, col, (F.col("_before") + (F.col("_n") + 1) / 2.0).alias(out))
    return df.join(ranks, on=[*keys, col], how="left")


def top1(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row per keys by ``order`` (ascending columns; negate for descending). A partial
    aggregate, not a sort."""
    rest = [c for c in df.columns if c not in keys]
    at = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    return (df.groupBy(*keys).agg(F.min_by(F.struct(*rest), at).alias("_r"))
            .select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]))


def quantile_bins(df: DataFrame, g: str, value: str, q: int = 5, out: str = "bin") -> DataFrame:
    """Equal-share bins 0..q-1 of a group value: linear edges, right-closed, lowest included; a NULL value has a NULL bin.

    Raises when edges repeat, as equal-share cutting has no answer then.
    """
    names = [f"_e{i}" for i in range(q + 1)]
    edges = quantile_columns(df, [], value, {n: i / q for i, n in enumerate(names)})
    arr = edges.select(F.when(
        F.size(F.array_distinct(F.array(*names))) < q + 1, F.raise_error(F.lit("duplicate bin edges")))
        .otherwise(F.array(*names)).cast("array<double>")).scalar()
    inner = F.slice(F.col("_edges"), 2, q - 1)
    place = F.size(F.filter(inner, lambda e: e < F.col(value)))
    return df.withColumn("_edges", arr).withColumn(out, F.when(F.col(value).isNotNull(), place)).drop("_edges")


def grid_bins(df: DataFrame, keys: list[str], col: str, probs: list[float], out: str = "bin") -> DataFrame:
    """Upper edge of the right-closed quantile bin of each row; the minimum itself and rows with a NULL key get NULL."""
    names = [f"_e{i}" for i in range(len(probs))]
    edges = quantile_columns(df, keys, col, dict(zip(names, probs)))
    upper = F.filter(F.array(*[F.col(n) for n in names[1:]]), lambda e: e >= F.col(col))
    value = F.when(F.col(col) > F.col(names[0]), F.array_min(upper))
    return df.join(edges, keys, "left").withColumn(out, value).drop(*names)


def impute_group_mean(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """NULL to the mean of the row's group; rows with a NULL key stay as they are."""
    means = df.groupBy(*keys).agg(*[F.avg(c).alias(f"_m_{c}") for c in cols])
    return df.join(means, keys, "left").select(
        *[F.coalesce(F.col(c), F.col(f"_m_{c}")).alias(c) if c in cols else F.col(c) for c in df.columns])


def share_above(df: DataFrame, keys: list[str], col: str, out: str = "share_above") -> DataFrame:
    """Share of rows strictly above each row, from counts of distinct values; NULL for a NULL value or key."""
    hist = df.filter(F.col(col).isNotNull()).groupBy(*keys, col).agg(F.count(F.lit(1)).alias("_n"))
    ranked = scan(hist, keys, [col], {"_a": ("sum", "_n")}, reverse=True, exclusive=True, totals={"_t": "_n"})
    return df.join(ranked.select(*keys, col, div(F.col("_a"), F.col("_t")).alias(out)), [*keys, col], "left")


def last_run_start(df: DataFrame, keys: list[str], order: list[str], cond: Column) -> DataFrame:
    """First row of the last unbroken run that meets ``cond`` and reaches the final row of the run.

    One aggregate finds the last hit, a second the last miss before it, a third the first hit after
    that miss: no sort of the whole group.
    """
    at = F.struct(*[F.col(c) for c in order])
    rows = df.select(*keys, at.alias("_at"), F.coalesce(cond, F.lit(False)).alias("_hit"))
    k = keys or ["_all"]
    if not keys:
        rows = rows.withColumn("_all", F.lit(1))
    last_hit = rows.filter("_hit").groupBy(*k).agg(F.max("_at").alias("_last"))
    misses = (rows.filter("not _hit").join(last_hit, k).filter(F.col("_at") < F.col("_last"))
              .groupBy(*k).agg(F.max("_at").alias("_miss")))
    start = (rows.filter("_hit").join(misses, k, "left")
             .filter(F.col("_miss").isNull() | (F.col("_at") > F.col("_miss")))
             .groupBy(*k).agg(F.min("_at").alias("_start")))
    return start.select(*keys, *[F.col(f"_start.{c}").alias(c) for c in order])
