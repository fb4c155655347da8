"""Curves, cut-offs and operating points.

A grid of thresholds is never joined to the rows: each distinct score is mapped to its place on the
grid, counted there, and the counts are accumulated over the grid, whose length is a parameter.
Positive means score > t for sensitivity and specificity, score >= t for PPV.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .ordered import quantile_columns, scan
from .ranking import div, score_histogram


def sens_spec(df: DataFrame, keys: list[str], t: Column | float, y: str = "y", s: str = "score") -> DataFrame:
    """Sensitivity and specificity at t (positive when s > t)."""
    hit = F.col(s) > t
    return df.groupBy(*keys).agg(
        F.avg(F.when(F.col(y) == 1, hit.cast("double"))).alias("sens"),
        F.avg(F.when(F.col(y) == 0, (~hit).cast("double"))).alias("spec"))


def ppv_at(df: DataFrame, keys: list[str], t: Column | float, y: str = "y", s: str = "score") -> DataFrame:
    """Positive predictive value at t (positive when s >= t)."""
    return df.filter(F.col(y).isin(0, 1)).groupBy(*keys).agg(
        F.avg(F.when(F.col(s) >= t, F.col(y).cast("double"))).alias("ppv"))


def _grid_place(value: Column, lo: Column, step: Column, num: int, *, equal: bool) -> Column:
    """Number of grid points lo + j*step below ``value`` (or, with ``equal``, not above it)."""
    guess = F.when(step > 0, F.floor((value - lo) / step)).otherwise(0).cast("bigint")
    best = F.lit(0).cast("bigint")
    # the guess may be off by one through rounding: count the points around it directly
    below = (lambda j: lo + j * step <= value) if equal else (lambda j: lo + j * step < value)
    for shift in (-1, 0, 1):
        j = guess + shift
        best = F.greatest(best, F.when(below(j), j + 1).otherwise(0))
    flat = F.when((lo <= value) if equal else (lo < value), num).otherwise(0)
    return F.when(step > 0, F.least(best, F.lit(num).cast("bigint"))).otherwise(flat).cast("bigint")


def threshold_grid(df: DataFrame, keys: list[str], num: int, lo_factor: float, hi_factor: float,
                   y: str = "y", s: str = "score") -> DataFrame:
    """Counts of positives and negatives above (gt) and at or above (ge) each grid threshold.

    The grid runs from lo_factor * min to hi_factor * max of the positives' scores.
    """
    k = keys or ["_all"]
    hist = score_histogram(df, keys, y, s)
    if not keys:
        hist = hist.withColumn("_all", F.lit(1))
    span = hist.groupBy(*k).agg(
        (F.min(F.when(F.col("p") > 0, F.col(s))) * lo_factor).alias("_lo"),
        (F.max(F.when(F.col("p") > 0, F.col(s))) * hi_factor).alias("_hi"),
        F.sum("p").alias("n1"), F.sum("n").alias("n0")).filter(F.col("n1") > 0)
    span = span.withColumn("_step", (F.col("_hi") - F.col("_lo")) / (num - 1))
    placed = hist.join(span.select(*k, "_lo", "_step"), on=k)
    cells = placed.select(*k, F.explode(F.array(
        F.struct(F.lit("gt").alias("side"), _grid_place(F.col(s), F.col("_lo"), F.col("_step"), num, equal=False).alias("at"),
                 F.col("p"), F.col("n")),
        F.struct(F.lit("ge").alias("side"), _grid_place(F.col(s), F.col("_lo"), F.col("_step"), num, equal=True).alias("at"),
                 F.col("p"), F.col("n")))).alias("_c")).select(*k, "_c.*")
    cells = cells.groupBy(*k, "at").agg(*[
        F.sum(F.when(F.col("side") == side, F.col(c)).otherwise(0)).alias(f"{c}_{side}")
        for side in ("gt", "ge") for c in ("p", "n")])
    points = span.withColumn("j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(num - 1).cast("bigint"))))
    # a score with `at` points below it exceeds thresholds 0 .. at-1
    joined = points.join(cells.withColumn("j", F.col("at") - 1).drop("at"), on=[*k, "j"], how="left")
    up = W.partitionBy(*k).orderBy(F.col("j").desc()).rowsBetween(W.unboundedPreceding, 0)
    out = joined.select(*k, "j", (F.col("_lo") + F.col("j") * F.col("_step")).alias("thresh"), "n1", "n0", *[
        F.coalesce(F.sum(f"{c}_{side}").over(up), F.lit(0)).alias(f"{c}_{side}")
        for side in ("gt", "ge") for c in ("p", "n")])
    return out if keys else out.drop("_all")


def roc_grid(df: DataFrame, keys: list[str], num: int = 100, y: str = "y", s: str = "score") -> DataFrame:
    """tpr and fpr on an even grid of thresholds."""
    g = threshold_grid(df, keys, num, 0.99, 1.01, y, s)
    return g.select(*keys, "j", "thresh", div(F.col("p_gt"), F.col("n1")).alias("tpr"),
                    div(F.col("n_gt"), F.col("n0")).alias("fpr"))


def pr_grid(df: DataFrame, keys: list[str], num: int = 1000, y: str = "y", s: str = "score") -> DataFrame:
    """Recall (s > t) and precision (s >= t) on an even grid of thresholds."""
    g = threshold_grid(df, keys, num, 0.99, 0.99, y, s)
    return g.select(*keys, "j", "thresh", div(F.col("p_gt"), F.col("n1")).alias("tpr"),
                    div(F.col("p_ge"), F.col("p_ge") + F.col("n_ge")).alias("precision"))


def threshold_for(df: DataFrame, keys: list[str], target: float, metric: str = "sens", y: str = "y",
                  s: str = "score") -> DataFrame:
    """Distinct score whose sensitivity (or specificity) is closest to the target; ties: lowest score."""
    hist = score_histogram(df, keys, y, s)
    col = "p" if metric == "sens" else "n"
    ranked = scan(hist, keys, [s], {"_above": ("sum", col)}, reverse=True, exclusive=True,
                  totals={"_tot": col})
    share = div(F.col("_above"), F.col("_tot"))
    value = share if metric == "sens" else 1 - share
    return (ranked.filter(F.col("_tot") > 0).groupBy(*keys)
            .agg(F.min(F.struct(F.round(F.abs(value - target), 12).alias("d"), F.col(s).alias("t"),
                                value.alias("m"))).alias("_b"))
            .select(*keys, F.col("_b.t").alias("thresh"), F.col("_b.m").alias(metric)))


def threshold_for_ppv(df: DataFrame, keys: list[str], target: float, side: str = "inf", num: int = 100,
                      y: str = "y", s: str = "score") -> DataFrame:
    """Threshold with PPV closest to the target, among a grid and all positives' scores.

    side 'inf' takes the lowest of tied thresholds, 'sup' the highest.
    """
    grid = threshold_grid(df, keys, num, 1.0, 1.0, y, s)
    on_grid = grid.select(*keys, F.col("thresh").alias("t"),
                          div(F.col("p_ge"), F.col("p_ge") + F.col("n_ge")).alias("ppv"))
    hist = score_histogram(df, keys, y, s)
    ranked = scan(hist, keys, [s], {"_tp": ("sum", "p"), "_fp": ("sum", "n")}, reverse=True)
    on_scores = ranked.filter(F.col("p") > 0).select(
        *keys, F.col(s).alias("t"), div(F.col("_tp"), F.col("_tp") + F.col("_fp")).alias("ppv"))
    sign = 1 if side == "inf" else -1
    best = F.min(F.struct(F.round((F.col("ppv") - target) ** 2, 12).alias("d"),
                          (F.col("t") * sign).alias("o"), F.col("t").alias("t"), F.col("ppv").alias("ppv")))
    return (on_grid.unionByName(on_scores).filter(F.col("ppv").isNotNull()).groupBy(*keys)
            .agg(best.alias("_b")).select(*keys, F.col("_b.t").alias("thresh"), F.col("_b.ppv").alias("ppv")))


def threshold_balance(df: DataFrame, keys: list[str], num: int = 250, y: str = "y", s: str = "score") -> DataFrame:
    """Threshold whose predicted share is nearest the observed share; ties: lowest."""
    g = threshold_grid(df, keys, num, 0.99, 1.01, y, s)
    n = F.col("n1") + F.col("n0")
    gap = div(F.col("p_gt") + F.col("n_gt"), n) - div(F.col("n1"), n)
    return (g.groupBy(*keys)
            .agg(F.min(F.struct(F.round(gap * gap, 12).alias("d"), F.col("j"), F.col("thresh"))).alias("_b"))
            .select(*keys, F.col("_b.thresh").alias("thresh"), F.col("_b.j").alias("j")))


def bins_by_edges(df: DataFrame, edges: DataFrame, keys: list[str], s: str, edge_cols: list[str],
                  out: str = "bin") -> DataFrame:
    """Index i of the right-closed bin (edge i-1, edge i] of each row; NULL at or below the first edge.

    Repeated edges: a value belongs to the first bin it fits, so the later copies stay empty. Rows with a
    NULL key or without edges stay, their bin is NULL.
    """
    data = df.join(edges, on=keys, how="left")
    place = F.size(F.filter(F.array(*[F.col(c) for c in edge_cols]), lambda e: e < F.col(s)))
    return data.withColumn(out, F.when(place > 0, place)).drop(*edge_cols)


def ppv_by_percentile(df: DataFrame, keys: list[str], probs: list[float], y: str = "y",
                      s: str = "score") -> DataFrame:
    """PPV and sensitivity at score percentiles, accumulated from the top; long form.

    Returns keys, pp, metric, value, qq; the lowest bin is left out.
    """
    names = [f"_e{i}" for i in range(len(probs))]
    edges = quantile_columns(df, keys, s, dict(zip(names, probs)))
    hist = score_histogram(df, keys, y, s)
    binned = bins_by_edges(hist, edges, keys, s, names)
    counts = binned.filter(F.col("bin").isNotNull()).groupBy(*keys, "bin").agg(
        F.sum("n").alias("y0"), F.sum("p").alias("y1"))
    # one row per bin: windows over the bins of a key are bounded by the length of probs
    top = W.partitionBy(*keys).orderBy(F.col("bin").desc()).rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy(*keys)
    acc = counts.select(*keys, "bin", F.sum("y0").over(top).alias("y0"), F.sum("y1").over(top).alias("y1"),
                        F.sum("y1").over(whole).alias("y1tot")).filter(F.col("bin") > 1)
    pp = F.element_at(F.array(*[F.lit(float(p)) for p in probs]), F.col("bin") + 1)
    labelled = acc.join(edges, on=keys).select(
        *keys, pp.alias("pp"),
        F.element_at(F.array(*[F.col(c) for c in names]), F.col("bin") + 1).alias("qq"),
        div(F.col("y1"), F.col("y1") + F.col("y0")).alias("ppv"),
        div(F.col("y1"), F.col("y1tot")).alias("sens"))
    return labelled.unpivot([*keys, "pp", "qq"], ["ppv", "sens"], "metric", "value")


def transfer_cutoffs(df: DataFrame, cuts: DataFrame, keys: list[str], cut_id: str, cut: str,
                     y: str = "y", s: str = "score") -> DataFrame:
    """Apply score cut-offs of one table to the scores of another (positive when s >= cut).

    Returns keys, cut_id, ppv, sens; a PPV of 0 becomes NULL. The cut-offs of a key travel as one
    sorted array (their number does not grow with the data), each score is counted at its place.
    """
    arr = cuts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(cut).alias("c"), F.col(cut_id).alias("id")))).alias("_cuts"))
    hist = score_histogram(df, keys, y, s)
    place = F.size(F.filter(F.col("_cuts"), lambda e: e["c"] <= F.col(s)))
    at = hist.join(arr.select(*keys, "_cuts"), on=keys).select(*keys, place.alias("_at"), "p", "n")
    at = at.groupBy(*keys, "_at").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    points = arr.select(*keys, F.posexplode("_cuts").alias("_i", "_cut"))
    points = points.select(*keys, (F.col("_i") + 1).alias("_at"), F.col("_cut.id").alias(cut_id))
    up = W.partitionBy(*keys).orderBy(F.col("_at").desc()).rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy(*keys)
    full = points.join(at, on=[*keys, "_at"], how="full")
    acc = full.select(*keys, cut_id, F.coalesce(F.sum("p").over(up), F.lit(0)).alias("tp"),
                      F.coalesce(F.sum("n").over(up), F.lit(0)).alias("fp"),
                      F.sum("p").over(whole).alias("pos")).filter(F.col(cut_id).isNotNull())
    return acc.select(*keys, cut_id,
                      F.when(F.col("tp") > 0, div(F.col("tp"), F.col("tp") + F.col("fp"))).alias("ppv"),
                      div(F.col("tp"), F.col("pos")).alias("sens"))


def confusion(df: DataFrame, keys: list[str], cut: Column | float, y: str = "y", s: str = "score") -> DataFrame:
    """tp, fp, fn, tn at a threshold (positive when s >= cut)."""
    hit, pos = F.col(s) >= cut, F.col(y) == 1
    cells = {"tp": hit & pos, "fp": hit & ~pos, "fn": ~hit & pos, "tn": ~hit & ~pos}
    return df.filter(F.col(y).isin(0, 1)).groupBy(*keys).agg(
        *[F.sum(c.cast("bigint")).alias(name) for name, c in cells.items()])
