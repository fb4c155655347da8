"""Uncertainty, tests and multiplicity control (section 2.J).

Bootstraps checkpoint what several later branches read: the numbered rows and the table of replicate
statistics. Everything else is lazy.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType

from ..functions.dist import beta_ppf, chi2_sf, norm_cdf, norm_ppf, normal_quantile, reg_beta
from ..session import cut_lineage
from .bulk import auc_exact, decompose_exact, decompose_replicates
from .ordered import quantile_columns, scan
from .ranking import auc, auc_by_group, auc_decompose, auc_from_histogram, div, score_histogram
from .resample import resample, with_weights
from .windows import midrank


def auc_se(a: Column, n1: Column, n0: Column, form: str = "hanley") -> Column:
    """Standard error of an AUROC: 'hanley' (Hanley-McNeil) or 'null' (no discrimination)."""
    n1, n0 = n1.cast("double"), n0.cast("double")
    if form == "null":
        return F.sqrt(div(n1 + n0 + 1, 12 * n1 * n0))
    q0 = a * (1 - a)
    q1 = a / (2 - a) - a * a
    q2 = 2 * a * a / (1 + a) - a * a
    return F.sqrt(div(q0 + (n1 - 1) * q1 + (n0 - 1) * q2, n1 * n0))


def normal_ci(df: DataFrame, est: str, se: str, alpha: float = 0.05, clip01: bool = False,
              null: float | None = None) -> DataFrame:
    """lb, ub by normal approximation; optionally cut to [0, 1] and flagged is_sig when lb > null."""
    z = normal_quantile(1 - alpha / 2)
    lb, ub = F.col(est) - z * F.col(se), F.col(est) + z * F.col(se)
    if clip01:
        lb, ub = F.greatest(lb, F.lit(0.0)), F.least(ub, F.lit(1.0))
    out = df.withColumn("lb", lb).withColumn("ub", ub)
    return out if null is None else out.withColumn("is_sig", (F.col("lb") > null).cast("int"))


def _boot_auc(weighted: DataFrame, keys: list[str], y: str = "y", s: str = "score",
              sketch_from: DataFrame | None = None) -> DataFrame:
    """AUROC per replicate. The histogram's shuffle is read by both halves of the scan; the bucket edges
    come from the rows before resampling (``sketch_from``), so nothing is computed twice."""
    return auc_from_histogram(score_histogram(weighted, keys, y, s, "weight"), keys, s, sketch_from)


# Metrics by name: (rows, keys, weight column or None, rows before resampling for the edges of a scan) -> keys, stat.
METRICS: dict[str, Callable[[DataFrame, list[str], str | None, DataFrame], DataFrame]] = {
    "auc": lambda df, keys, w, raw: auc_from_histogram(score_histogram(df, keys, weight=w), keys, sketch_from=raw.select("score")).select(*keys, F.col("auc").alias("stat")),
    "mean": lambda df, keys, w, raw: df.groupBy(*keys).agg(
        div(F.sum(F.col("y") * F.col(w)), F.sum(w)).alias("stat") if w else F.avg("y").alias("stat")),
    "r2": lambda df, keys, w, raw: _weighted_r2(df, keys, w),
}


def _weighted_r2(df: DataFrame, keys: list[str], weight: str | None) -> DataFrame:
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    y, yhat = F.col("y"), F.col("score")
    sums = df.groupBy(*keys).agg(F.sum(w).alias("_w"), F.sum(w * y).alias("_y"), F.sum(w * y * y).alias("_yy"),
                                 F.sum(w * (y - yhat) ** 2).alias("_r"))
    return sums.select(*keys, (1 - div(F.col("_r"), F.col("_yy") - F.col("_y") ** 2 / F.col("_w"))).alias("stat"))


def bootstrap_ci(df: DataFrame, keys: list[str], metric: str, order: list[str], reps: int, seed: int,
                 alpha: float = 0.05) -> DataFrame:
    """iid bootstrap within keys, percentiles of the replicates less their bias: stat, lb, ub."""
    fn = METRICS[metric]
    base = fn(df, keys, None, df)
    boot = cut_lineage(fn(resample(df, keys, order, reps, seed), [*keys, "rep"], "weight", df))
    q = quantile_columns(boot, keys, "stat", {"_lo": alpha / 2, "_hi": 1 - alpha / 2})
    mean = boot.groupBy(*keys).agg(F.avg("stat").alias("_mean"))
    joined = base.join(q, keys).join(mean, keys)
    bias = F.col("_mean") - F.col("stat")
    return joined.select(*keys, "stat", (F.col("_lo") - bias).alias("lb"), (F.col("_hi") - bias).alias("ub"))


def auc_bootstrap(df: DataFrame, keys: list[str], order: list[str], reps: int, seed: int, alpha: float = 0.05,
                  y: str = "y", s: str = "score") -> DataFrame:
    """Class-stratified bootstrap of the AUROC: auc, lb, ub."""
    base = auc(df, keys, y, s).filter((F.col("n1") > 0) & (F.col("n0") > 0)).select(*keys, "auc")
    boot = cut_lineage(_boot_auc(resample(df, [*keys, y], order, reps, seed), [*keys, "rep"], y, s, df.select(s)))
    q = quantile_columns(boot, keys, "auc", {"lb": alpha / 2, "ub": 1 - alpha / 2})
    return base.join(q, keys)


def cluster_bootstrap(groups: DataFrame, keys: list[str], g: str, reps: int, seed: int, alpha: float = 0.05) -> DataFrame:
    """Resample whole groups within keys; pair-weighted mean AUROC per replicate: auc, lb, ub.

    Input: keys, g, auc, n0n1 (one row per group).
    """
    def pooled(df, by, w):
        part = F.col("n0n1") * w
        return df.groupBy(*by).agg(div(F.sum(F.col("auc") * part), F.sum(F.when(F.col("auc").isNotNull(), part))).alias("auc"))

    groups = cut_lineage(groups)
    boot = cut_lineage(pooled(resample(groups, keys, [g], reps, seed), [*keys, "rep"], F.col("weight")))
    q = quantile_columns(boot, keys, "auc", {"lb": alpha / 2, "ub": 1 - alpha / 2})
    return pooled(groups, keys, F.lit(1.0)).join(q, keys)


def cluster_bootstrap_total(df: DataFrame, keys: list[str], g: str, reps: int, seed: int, alpha: float = 0.05, y: str = "y", s: str = "score") -> DataFrame:
    """keys, tt, auc, lb, ub: the within row by resampled groups, and the total row with a normal interval of the same rows."""
    groups = auc_by_group(df, keys, g, y, s).select(*keys, g, "auc", "n0n1")
    within = cluster_bootstrap(groups, keys, g, reps, seed, alpha).withColumn("tt", F.lit("within"))
    total = auc(df, keys, y, s).withColumn("_se", auc_se(F.col("auc"), F.col("n1"), F.col("n0")))
    total = normal_ci(total, "auc", "_se", alpha).withColumn("tt", F.lit("total"))
    names = [*keys, "tt", "auc", "lb", "ub"]
    return total.select(*names).unionByName(within.select(*names))


def decompose_bootstrap(df: DataFrame, keys: list[str], g: str, order: list[str], reps: int, seed: int,
                        alpha: float = 0.05, y: str = "y", s: str = "score", scheme: str = "exact") -> DataFrame:
    """Bootstrap of the decomposition: keys, tt, auc, lb, ub.

    scheme "exact" draws as many rows as there are, stratified by keys and class. "poisson" gives each row
    an independent Poisson(1) multiplicity instead, all replicates in one pass without a join of draws: for
    large strata, where the varying size does not matter. ``order`` must name a row there.
    """
    if scheme == "poisson":
        boot = cut_lineage(decompose_replicates(df, keys, g, order, reps, seed, y, s))
        q = quantile_columns(boot, [*keys, "tt"], "auc", {"lb": alpha / 2, "ub": 1 - alpha / 2})
        return auc_decompose(df, keys, g, y, s).select(*keys, "tt", "auc").join(q, [*keys, "tt"])
    boot = cut_lineage(decompose_exact(df, keys, g, order, reps, seed, y, s))
    q = quantile_columns(boot, [*keys, "tt"], "auc", {"lb": alpha / 2, "ub": 1 - alpha / 2})
    return auc_decompose(df, keys, g, y, s).select(*keys, "tt", "auc").join(q, [*keys, "tt"])


def compare_bootstrap(df: DataFrame, keys: list[str], a: str, b: str, order: list[str], reps: int, seed: int,
                      y: str = "y") -> DataFrame:
    """Two scores of the same cases, compared on the same draws within keys.

    One-class replicates are discarded. Returns the 2.5% quantiles of auc_b - auc_a, auc_a - 0.5,
    auc_b - 0.5 and p-values 1 - #(> 0) / (n + 1).
    """
    k = [*keys, "rep"]
    aucs = auc_exact(df, keys, {"a": a, "b": b}, order, reps, seed, y)
    wide = aucs.groupBy(*k).agg(F.max(F.when(F.col("which") == "a", F.col("auc"))).alias("_a"),
                                F.max(F.when(F.col("which") == "b", F.col("auc"))).alias("_b"))
    both = (wide.filter(F.col("_a").isNotNull() & F.col("_b").isNotNull())
            .select(*keys, (F.col("_b") - F.col("_a")).alias("diff"), (F.col("_a") - 0.5).alias("agg"),
                    (F.col("_b") - 0.5).alias("sub")))
    parts = ["diff", "agg", "sub"]
    long = cut_lineage(both.unpivot(keys, parts, "part", "v"))
    q = quantile_columns(long, [*keys, "part"], "v", {"q": 0.025})
    p = long.groupBy(*keys, "part").agg(
        (1 - F.sum((F.round("v", 12) > 0).cast("double")) / (F.count(F.lit(1)) + 1)).alias("p"))
    return q.join(p, [*keys, "part"])


def fdr(df: DataFrame, keys: list[str], p: str, id_col: str, out: str = "fdr") -> DataFrame:
    """Benjamini-Hochberg adjusted p-values within keys; ``id_col`` orders tied p-values."""
    one = cut_lineage(df.filter(F.col(p).isNotNull()).withColumn("_one", F.lit(1).cast("bigint")))
    ranked = scan(one, keys, [p, id_col], {"_rk": ("count", None)}, totals={"_m": "_one"})
    ranked = ranked.withColumn("_q", F.col(p) * F.col("_m") / F.col("_rk"))
    back = scan(ranked, keys, [p, id_col], {"_min": ("min", "_q")}, reverse=True)
    return back.withColumn(out, F.least(F.col("_min"), F.lit(1.0))).drop("_one", "_rk", "_m", "_q", "_min")


def chi_square(df: DataFrame, keys: list[str], level: str, side: str, sides: list, with_p: bool = True) -> DataFrame:
    """Independence of level and side (the listed values): stat, dof(, pval). Yates at 1 dof."""
    names = [f"_o{i}" for i in range(len(sides))]
    cells = df.groupBy(*keys, level).agg(*[
        F.sum((F.col(side) == v).cast("double")).alias(n) for n, v in zip(names, sides)])
    k = keys or ["_all"]
    if not keys:
        cells = cells.withColumn("_all", F.lit(1))
    totals = cells.groupBy(*k).agg(F.count(F.lit(1)).alias("_levels"), *[F.sum(n).alias(f"_t{n}") for n in names])
    row = sum((F.col(n) for n in names), F.lit(0.0))
    grand = sum((F.col(f"_t{n}") for n in names), F.lit(0.0))
    dof = (F.col("_levels") - 1) * (len(sides) - 1)
    part = F.lit(0.0)
    for n in names:
        expected = row * F.col(f"_t{n}") / grand
        gap = F.abs(F.col(n) - expected)
        gap = F.when(dof == 1, gap - F.least(gap, F.lit(0.5))).otherwise(gap)
        part = part + div(gap * gap, expected)
    out = cells.join(totals, k).groupBy(*keys).agg(F.sum(part).alias("stat"), F.max(dof).alias("dof"))
    return out.withColumn("pval", chi2_sf("stat", "dof")) if with_p else out


def mann_whitney(df: DataFrame, keys: list[str], side: str, sides: tuple, x: str) -> DataFrame:
    """U of the first side with the tie-corrected two-sided normal p (continuity 0.5): u, z, pval."""
    a, b = sides
    hist = df.filter(F.col(side).isin(a, b) & F.col(x).isNotNull()).groupBy(*keys, x).agg(
        F.sum((F.col(side) == a).cast("bigint")).alias("p"), F.sum((F.col(side) == b).cast("bigint")).alias("n"))
    ranked = scan(hist, keys, [x], {"_cn": ("sum", "n")}, exclusive=True, totals={"_na": "p", "_nb": "n"},
                  sketch_from=df.select(x))
    t = (F.col("p") + F.col("n")).cast("double")
    won = F.col("p").cast("double") * (F.col("_cn") + F.col("n") / 2.0)
    out = ranked.groupBy(*keys).agg(F.sum(won).alias("u"), F.max("_na").cast("double").alias("na"),
                                    F.max("_nb").cast("double").alias("nb"), F.sum(t * t * t - t).alias("_tie"))
    n = F.col("na") + F.col("nb")
    sd = F.sqrt(F.col("na") * F.col("nb") / 12 * ((n + 1) - F.col("_tie") / (n * (n - 1))))
    gap = F.col("u") - F.col("na") * F.col("nb") / 2
    z = div(F.sign(gap) * F.greatest(F.abs(gap) - 0.5, F.lit(0.0)), sd)
    return (out.withColumn("z", z).withColumn("pval", 2 * (1 - norm_cdf(F.abs(F.col("z")))))
            .select(*keys, "u", "na", "nb", "z", "pval"))


def prop_ci(df: DataFrame, x: str, n: str, method: str = "wald", alpha: float = 0.05) -> DataFrame:
    """prop, lb, ub of x events in n: 'wald', or 'beta' (exact, Clopper-Pearson)."""
    xs, ns = F.col(x).cast("double"), F.col(n).cast("double")
    out = df.withColumn("prop", div(xs, ns))
    if method == "wald":
        z = normal_quantile(1 - alpha / 2)
        se = F.sqrt(div(F.col("prop") * (1 - F.col("prop")), ns))
        return out.withColumn("lb", F.col("prop") - z * se).withColumn("ub", F.col("prop") + z * se)
    lo = F.when(xs == 0, 0.0).otherwise(beta_ppf(F.lit(alpha / 2), F.greatest(xs, F.lit(1.0)), ns - xs + 1))
    hi = F.when(xs == ns, 1.0).otherwise(beta_ppf(F.lit(1 - alpha / 2), xs + 1, F.greatest(ns - xs, F.lit(1.0))))
    return out.withColumn("lb", lo).withColumn("ub", hi)


def enrichment(df: DataFrame, keys: list[str], term: str, flag: str) -> DataFrame:
    """Log odds ratio of flagged rows in a term against the rest; NULL where a cell is empty."""
    yes, no = (F.col(flag) == 1).cast("bigint"), (F.col(flag) == 0).cast("bigint")
    cells = df.groupBy(*keys, term).agg(F.sum(yes).alias("true1"), F.sum(no).alias("false1"))
    totals = df.groupBy(*keys).agg(F.sum(yes).alias("_t"), F.sum(no).alias("_f"))
    joined = cells.join(totals, keys) if keys else cells.withColumn("_k", F.lit(1)).join(
        totals.withColumn("_k", F.lit(1)), "_k").drop("_k")
    out = joined.withColumn("true0", F.col("_t") - F.col("true1")).withColumn("false0", F.col("_f") - F.col("false1"))
    odds = div(F.col("true1").cast("double") * F.col("false0"), F.col("true0").cast("double") * F.col("false1"))
    inv = [div(F.lit(1.0), F.col(c)) for c in ("true1", "false1", "true0", "false0")]
    out = out.withColumn("lor", F.when(odds > 0, F.ln(odds)))
    out = out.withColumn("se", F.sqrt(inv[0] + inv[1] + inv[2] + inv[3])).withColumn("z", F.col("lor") / F.col("se"))
    return out.withColumn("pval", 2 * (1 - norm_cdf(F.abs(F.col("z"))))).drop("_t", "_f")


def spearman(df: DataFrame, keys: list[str], a: str, b: str, transform: bool = False) -> DataFrame:
    """Rank correlation by keys; ``transform`` gives 2 sin(pi r / 6)."""
    both = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    ranked = midrank(midrank(both, keys, a, "_ra"), keys, b, "_rb")
    rho = F.corr("_ra", "_rb")
    return ranked.groupBy(*keys).agg((2 * F.sin(rho * 3.141592653589793 / 6) if transform else rho).alias("rho"))


def _corr_replicates(df: DataFrame, keys: list[str], a: str, b: str, order: list[str], reps: int, seed: int, subreps: int) -> DataFrame:
    """keys, rep, sub, stat: correlation in every replicate, from weighted sums of blocks of rows."""
    lanes = reps * (subreps + 1)

    def sums(rows: pa.Table, w: np.ndarray) -> pa.Table:
        x, y = (rows[c].to_numpy() for c in (a, b))
        terms = np.column_stack([np.ones(len(x)), x, y, x * x, y * y, x * y])
        made = w.T.astype(float) @ terms
        own = [pa.array([rows[k][0].as_py()] * lanes, rows.schema.field(k).type) for k in keys]
        return pa.table([*own, pa.array(np.arange(lanes), pa.int32()), *made.T], names=[*keys, "_lane", "n", "x", "y", "xx", "yy", "xy"])

    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    parts = with_weights(df.select(*keys, *order, F.col(a).cast("double").alias(a), F.col(b).cast("double").alias(b)), keys, order, reps, seed, sums,
                         f"{kinds}, _lane int, n double, x double, y double, xx double, yy double, xy double", subreps)
    n, x, y, xx, yy, xy = (F.sum(c) for c in ("n", "x", "y", "xx", "yy", "xy"))
    stat = div(n * xy - x * y, F.sqrt(n * xx - x * x) * F.sqrt(n * yy - y * y))
    rep, sub = (F.floor(F.col("_lane") / (subreps + 1)) + 1).cast("int"), F.col("_lane") % (subreps + 1)
    return parts.groupBy(*keys, "_lane").agg(stat.alias("stat")).select(*keys, rep.alias("rep"), sub.alias("sub"), "stat")


def student_bounds(boot: DataFrame, base: DataFrame, keys: list[str], alpha: float) -> DataFrame:
    """Studentized, normal and percentile bounds from nested replicates.

    boot: keys, rep, sub, stat (sub 0 is the replicate itself); base: keys, stat.
    """
    boot, base = cut_lineage(boot), cut_lineage(base)
    outer = boot.filter("sub = 0").select(*keys, "rep", F.col("stat").alias("_b"))
    inner = boot.filter("sub > 0").groupBy(*keys, "rep").agg(F.stddev_samp("stat").alias("_se"))
    t = outer.join(inner, [*keys, "rep"]).join(base, keys).withColumn("_t", div(F.col("_b") - F.col("stat"), F.col("_se")))
    lo, hi = alpha / 2, 1 - alpha / 2
    qt = quantile_columns(t, keys, "_t", {"_tl": lo, "_th": hi})
    qb = quantile_columns(outer, keys, "_b", {"_bl": lo, "_bh": hi})
    se = outer.groupBy(*keys).agg(F.stddev_samp("_b").alias("_sb"))
    z = normal_quantile(hi)
    joined = base.join(se, keys).join(qt, keys).join(qb, keys)
    s, sb = F.col("stat"), F.col("_sb")
    rows = F.array(
        F.struct(F.lit("student").alias("tt"), (s - sb * F.col("_th")).alias("lb"), (s - sb * F.col("_tl")).alias("ub")),
        F.struct(F.lit("normal").alias("tt"), (s - sb * z).alias("lb"), (s + sb * z).alias("ub")),
        F.struct(F.lit("quant").alias("tt"), F.col("_bl").alias("lb"), F.col("_bh").alias("ub")))
    return joined.select(*keys, "stat", F.explode(rows).alias("_x")).select(*keys, "stat", "_x.*")


def spearman_ci(df: DataFrame, keys: list[str], a: str, b: str, id_col: str, reps: int, subreps: int, seed: int,
                alpha: float = 0.05) -> DataFrame:
    """Nested bootstrap bounds of the rank correlation; ranks are taken once, before resampling."""
    both = cut_lineage(df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()))
    ranked = cut_lineage(midrank(midrank(both, keys, a, "_ra"), keys, b, "_rb").select(*keys, id_col, "_ra", "_rb"))
    base = ranked.groupBy(*keys).agg(F.corr("_ra", "_rb").alias("stat"))
    boot = _corr_replicates(ranked, keys, "_ra", "_rb", [id_col], reps, seed, subreps)
    return student_bounds(boot, base, keys, alpha).withColumnRenamed("stat", "rho")


def quantile_lower_bound(df: DataFrame, keys: list[str], value: str, id_col: str, target: float, reps: int,
                         subreps: int, seed: int, alpha: float = 0.05) -> DataFrame:
    """Quantile of the positives' scores with its studentized lower bound: thresh, se, crit, thresh_lb."""
    df = cut_lineage(df.select(*keys, id_col, value))
    base = quantile_columns(df, keys, value, {"thresh": target})
    rows = cut_lineage(resample(df, keys, [id_col], reps, seed, subreps))
    boot = cut_lineage(quantile_columns(rows, [*keys, "rep", "sub"], value, {"stat": target}, weight="weight"))
    outer = boot.filter("sub = 0").select(*keys, "rep", F.col("stat").alias("_b"))
    inner = boot.filter("sub > 0").groupBy(*keys, "rep").agg(F.stddev_samp("stat").alias("_se"))
    z = outer.join(inner, [*keys, "rep"]).join(base, keys).withColumn("_z", div(F.col("_b") - F.col("thresh"), F.col("_se")))
    crit = quantile_columns(z, keys, "_z", {"crit": 1 - alpha})
    se = outer.groupBy(*keys).agg(F.stddev_samp("_b").alias("se"))
    return (base.join(se, keys).join(crit, keys)
            .withColumn("thresh_lb", F.col("thresh") - F.col("se") * F.col("crit")))


@F.pandas_udf(LongType())
def _order_rank(n: pd.Series, k: pd.Series, j: pd.Series) -> pd.Series:
    size, p, level = n.to_numpy(float), 1 - k.to_numpy(float), 1 - j.to_numpy(float)
    lo, hi = np.zeros(len(size)), size.copy()
    while (lo < hi).any():  # P(X < l) = 1 - I_p(l, n-l+1) grows with l: largest l with P(X < l) <= 1-j
        mid = np.floor((lo + hi + 1) / 2)
        fits = 1 - reg_beta(np.maximum(mid, 1), size - mid + 1, p) <= level
        open_ = lo < hi
        lo, hi = np.where(open_ & fits, mid, lo), np.where(open_ & ~fits, mid - 1, hi)
    return pd.Series(np.maximum(lo, 1).astype("int64"))


def order_threshold(df: DataFrame, n: str, k: str, j: str, out: str = "rank") -> DataFrame:
    """Largest order statistic usable as a threshold: binomial(n, 1-k) falls below it with at most 1-j.

    A bisection on the incomplete beta function, so the cost does not grow with n.
    """
    return df.withColumn(out, _order_rank(F.col(n).cast("bigint"), F.col(k).cast("double"), F.col(j).cast("double")))


def sample_size(df: DataFrame, power: str, target: float, margin: float, alpha: float, out: str = "n_star") -> DataFrame:
    """Events needed to show sensitivity above target - margin at each power."""
    low = target - margin
    beta = 1 - F.col(power)
    term = (target * (1 - target)) ** 0.5 * norm_ppf(beta) - (low * (1 - low)) ** 0.5 * normal_quantile(1 - alpha)
    return df.withColumn(out, (term / (low - target)) ** 2)


def null_cut(df: DataFrame, null: DataFrame, keys: list[str], col: str, q: float = 0.95) -> DataFrame:
    """Flag values at or above the q quantile of a null reference, per keys."""
    cut = quantile_columns(null, keys, col, {"cut": q})
    return df.join(cut, keys).withColumn("is_sig", (F.col(col) >= F.col("cut")).cast("int"))


def total_gap_bootstrap(df: DataFrame, keys: list[str], preds: list[str], order: list[str], reps: int, seed: int,
                        alpha: float = 0.05, y: str = "y") -> DataFrame:
    """Bootstrap of event total minus predicted total: keys, mdl, lower quantile yd."""
    w = resample(df, keys, order, reps, seed)
    sums = w.groupBy(*keys, "rep").agg(*[
        F.sum(F.col("weight") * (F.col(y) - F.col(p))).alias(p) for p in preds])
    return quantile_columns(cut_lineage(sums.unpivot([*keys, "rep"], preds, "mdl", "yd")), [*keys, "mdl"], "yd", {"yd": alpha / 2})


def replicate_ci(df: DataFrame, keys: list[str], value: str, alpha: float = 0.05) -> DataFrame:
    """Percentile bounds over replicates; is_sig when both bounds have one sign."""
    q = quantile_columns(df, keys, value, {"lb": alpha / 2, "ub": 1 - alpha / 2})
    return q.withColumn("is_sig", (F.signum("lb") == F.signum("ub")).cast("int"))


def mann_whitney_ci(df: DataFrame, keys: list[str], y: str, x: str, id_col: str, reps: int, subreps: int, seed: int,
                    alpha: float = 0.05) -> DataFrame:
    """Nested bootstrap bounds of the Mann-Whitney statistic (as AUROC), both samples resampled."""
    df = cut_lineage(df.select(*keys, y, x, id_col))
    base = auc(df, keys, y, x).select(*keys, F.col("auc").alias("stat"))
    w = resample(df, [*keys, y], [id_col], reps, seed, subreps)
    boot = _boot_auc(w, [*keys, "rep", "sub"], y, x, df.select(x)).select(*keys, "rep", "sub", F.col("auc").alias("stat"))
    return student_bounds(boot, base, keys, alpha)


def significant_share(df: DataFrame, keys: list[str], flag: str) -> DataFrame:
    """Counts and shares of flagged groups: keys, flag, n, pct (both flag values listed)."""
    c = df.groupBy(*keys).agg(*[F.sum((F.col(flag) == v).cast("bigint")).alias(str(v)) for v in (0, 1)],
                              F.count(flag).alias("_tot"))
    return c.unpivot([*keys, "_tot"], ["0", "1"], flag, "n").select(
        *keys, F.col(flag).cast("bigint").alias(flag), "n", div(F.col("n"), F.col("_tot")).alias("pct"))
