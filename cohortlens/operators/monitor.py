"""Deployment and sequential monitoring (section 2.M)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.dist import norm_cdf
from .inference import chi_square, fdr, prop_ci
from .ordered import scan
from .profile import level_share
from .ranking import div
from .windows import last_run_start


def route(df: DataFrame, sig_groups: DataFrame, g: str, preds: str, baseline: str) -> DataFrame:
    """Model score where the group is significant, baseline elsewhere: adds mdl and phat."""
    sig = sig_groups.select(g).distinct().withColumn("_sig", F.lit(1))
    routed = df.join(sig, g, "left")
    use = F.col("_sig").isNotNull()
    return (routed.withColumn("mdl", F.when(use, "preds").otherwise("nb"))
            .withColumn("phat", F.when(use, F.col(preds)).otherwise(F.col(baseline))).drop("_sig"))


def apply_thresholds(df: DataFrame, thresholds: DataFrame, on: str = "mdl", score: str = "phat",
                     thresh: str = "thresh") -> DataFrame:
    """yhat = score >= the threshold of the row's route."""
    return df.join(thresholds.select(on, thresh), on).withColumn(
        "yhat", (F.col(score) >= F.col(thresh)).cast("bigint")).drop(thresh)


def daily_counts(df: DataFrame, keys: list[str], date: str, y: str = "y", yhat: str = "yhat") -> DataFrame:
    """n, y, tp, fp by day."""
    hit, pos = F.col(yhat) == 1, F.col(y) == 1
    return df.groupBy(*keys, date).agg(
        F.count(F.lit(1)).alias("n"), F.sum(pos.cast("bigint")).alias("y"),
        F.sum((hit & pos).cast("bigint")).alias("tp"), F.sum((hit & ~pos).cast("bigint")).alias("fp"))


def monitor_daily(daily: DataFrame, keys: list[str], date: str, target: float) -> DataFrame:
    """Running sensitivity and precision from daily counts, tested against the trial target.

    Days before the first event are left out. A sensitivity of 0 has no standard error: its statistic is
    minus infinity and its p-value 1. Without keys, days of sensitivity 1 (no test) go too; by keys those
    stay, with NULL test columns, and only days without a sensitivity or precision go.
    """
    run = scan(daily, keys, [date], {"n_rt": ("sum", "n"), "_y": ("sum", "y"), "_tp": ("sum", "tp"), "_fp": ("sum", "fp")})
    out = run.filter(F.col("_y") > 0).select(*keys, date, "n_rt", F.col("_y").alias("y"), F.col("_tp").alias("tp"),
                                             F.col("_fp").alias("fp"))
    flat = (F.col("tp") == 0) | (F.col("tp") == F.col("y"))  # no standard error
    out = out.withColumn("sens", div(F.col("tp"), F.col("y"))).withColumn("prec", div(F.col("tp"), F.col("tp") + F.col("fp")))
    out = (out.withColumn("se_sens", F.sqrt(F.col("sens") * (1 - F.col("sens")) / F.col("y")))
           .withColumn("se_prec", F.sqrt(div(F.col("prec") * (1 - F.col("prec")), F.col("tp") + F.col("fp"))))
           .withColumn("zscore", F.when(~flat, (F.col("sens") - target) / F.col("se_sens")).when(F.col("sens") < target, F.lit(float("-inf")))))
    known = F.col("prec").isNotNull() if keys else ~flat | (F.col("tp") < target * F.col("y"))
    pval = F.when(F.col("zscore") == float("-inf"), F.lit(1.0)).otherwise(1 - norm_cdf(F.col("zscore")))
    return out.filter(known).withColumn("pval", pval)


def monitor(df: DataFrame, keys: list[str], date: str, target: float, y: str = "y", yhat: str = "yhat") -> DataFrame:
    """Sequential monitor over all rows (keys empty) or by route."""
    return monitor_daily(daily_counts(df, keys, date, y, yhat), keys, date, target)


def days_to_reject(monitored: DataFrame, first_date: Column, date: str, alpha: float = 0.05) -> DataFrame:
    """Start of the last unbroken significant run, and its distance in days from the first date."""
    start = last_run_start(monitored, [], [date], F.col("pval") < alpha)
    return start.select(F.col(date).alias("date_reject"), F.datediff(F.col(date), first_date).alias("days"))


def power_at(monitored: DataFrame, grid: DataFrame, n: str, power: str = "power", at: str = "n_rt") -> DataFrame:
    """Power at each accrued n, linear between the points of a (power, n) grid, flat outside it.

    The grid's length is a parameter of the design; it reaches the rows as one scalar array.
    """
    arr = grid.agg(F.array_sort(F.collect_list(F.struct(F.col(n).cast("double").alias("n"), F.col(power).alias("p"))))).scalar()
    d = monitored.withColumn("_g", arr)
    x = F.col(at).cast("double")
    i = F.size(F.filter(F.col("_g"), lambda e: e["n"] <= F.col(at).cast("double")))
    lo, hi = F.element_at("_g", F.greatest(F.col("_i"), F.lit(1))), F.element_at("_g", F.least(F.col("_i") + 1, F.size("_g")))
    frac = F.coalesce(div(x - lo["n"], hi["n"] - lo["n"]), F.lit(0.0))
    value = F.when(F.col("_i") == 0, lo["p"]).otherwise(lo["p"] + frac * (hi["p"] - lo["p"]))
    return d.withColumn("_i", i).withColumn("power", value).drop("_g", "_i")


def compare_rates(df: DataFrame, term: str, side: str, sides: tuple, y: str = "y", exact: bool = True) -> DataFrame:
    """Event rates by term and table; terms must be in both tables and have events in both."""
    counts = df.filter(F.col(y).isin(0, 1)).groupBy(term, side).agg(
        F.sum(F.col(y)).alias("y1"), F.count(F.lit(1)).alias("tot"))
    ok = (counts.groupBy(term).agg(F.count(F.lit(1)).alias("_k"), F.min("y1").alias("_m"))
          .filter((F.col("_k") == len(sides)) & (F.col("_m") > 0)))
    return prop_ci(counts.join(ok.select(term), term, "left_semi"), "y1", "tot", "beta" if exact else "wald")


def calibration(df: DataFrame, side: str, y: str, preds: list[str]) -> DataFrame:
    """Calibration in the large: observed and mean predicted rate by table, with Wald bounds."""
    cols = [y, *preds]
    means = df.groupBy(side).agg(F.count(F.lit(1)).cast("double").alias("tot"),
                                 *[F.avg(F.col(c).cast("double")).alias(c) for c in cols])
    long = means.unpivot([side, "tot"], cols, "mdl", "p")
    return prop_ci(long.withColumn("_x", F.col("p") * F.col("tot")), "_x", "tot").select(side, "mdl", "prop", "lb", "ub")


def usable_groups(df: DataFrame, g: str, y: str = "y", min_pairs: int = 30, min_events: int = 2) -> DataFrame:
    """Groups with both classes, enough pairs and enough events."""
    c = df.groupBy(g).agg(F.sum((F.col(y) == 0).cast("bigint")).alias("y0"), F.sum((F.col(y) == 1).cast("bigint")).alias("y1"))
    return c.filter((F.col("y0") > 0) & (F.col("y1") > 0)
                    & (F.col("y0").cast("double") * F.col("y1") >= min_pairs) & (F.col("y1") >= min_events))


def compare_tables(a: DataFrame, b: DataFrame, cols: list[str], names: tuple[str, str] = ("a", "b"),
                   with_p: bool = True) -> DataFrame:
    """Level shares of both tables and the test of each column, in one long table."""
    def tall(df, tag):
        return df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot([], cols, "name", "level").withColumn("tt", F.lit(tag))

    both = tall(a, names[0]).unionByName(tall(b, names[1])).filter(F.col("level").isNotNull())
    shares = level_share(both, ["name", "tt"], "level")
    tests = chi_square(both, ["name"], "level", "tt", list(names), with_p)
    if with_p:
        tests = fdr(tests.withColumn("_k", F.lit(1)), ["_k"], "pval", "name").drop("_k")
    return shares.join(tests, "name")


def profile_hits(hits: DataFrame, features: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Feature levels of the true positives: name, level, n."""
    f = hits.select(key).join(features.select(key, *[F.col(c).cast("string").alias(c) for c in cols]), key)
    return f.unpivot([], cols, "name", "level").groupBy("name", "level").agg(F.count(F.lit(1)).alias("n"))


def sum_risks(df: DataFrame, keys: list[str], label: str, labels: list[str], phat: str, y: str) -> DataFrame:
    """Sum of component risks, and whether any component happened."""
    part = df.filter(F.col(label).isin(*labels)).groupBy(*keys)
    return part.agg(F.sum(phat).alias("phat"), F.least(F.sum(F.when(F.col(y) == 1, 1).otherwise(0)), F.lit(1)).alias("y"))

