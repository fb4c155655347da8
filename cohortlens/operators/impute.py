"""Imputation (L20 to L26)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage, cut_spread
from .features import holdout
from .inference import bootstrap_ci
from .models import naive_bayes_stack, univariate_fit, univariate_scores
from .ordered import quantile_columns
from .paths import lasso_cv
from .profile import missing_profile, mode_of
from .ranking import auc, div
from .thresholds import pr_grid, threshold_balance


def impute_mode(df: DataFrame, cols: list[str], below: int = 10) -> DataFrame:
    """Columns with a few missing values (under ``below``) take their mode; others stay. Lazy: counts and
    modes, one of each per column, arrive as two scalar subqueries."""
    modes = mode_of(df, cols).agg(F.map_from_entries(F.collect_list(F.struct("name", "mode")))).scalar()
    missing = df.agg(F.create_map(*[x for c in cols for x in (F.lit(c), F.sum(F.col(c).isNull().cast("bigint")))])).scalar()
    own = "_fill"
    while own in df.columns:
        own = "_" + own
    out = []
    for c in df.columns:
        if c not in cols:
            out.append(F.col(c))
            continue
        few = F.col(f"{own}.n")[c] < below
        mode = F.try_element_at(F.col(f"{own}.m"), F.lit(c)).cast(df.schema[c].dataType)
        out.append(F.when(F.col(c).isNull() & few, mode).otherwise(F.col(c)).alias(c))
    return df.withColumn(own, F.struct(modes.alias("m"), missing.alias("n"))).select(*out)


def classify_missing(df: DataFrame, period: str, cols: list[str]) -> DataFrame:
    """complete, partial (some missing, never a whole period) or year (a whole period missing)."""
    p = missing_profile(df, period, cols).groupBy("name").agg(F.max("share").alias("worst"))
    return p.select("name", "worst", F.when(F.col("worst") == 0, "complete").when(F.col("worst") < 1, "partial").otherwise("year").alias("kind"))


def lookup_impute(df: DataFrame, ref: DataFrame, g: str, col: str) -> DataFrame:
    """Missing numeric to the count-weighted mean of the reference table's values for the group."""
    table = ref.filter(F.col(col).isNotNull()).groupBy(g, F.col(col).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    means = table.groupBy(g).agg(div(F.sum(F.col("_v") * F.col("_n")), F.sum("_n")).alias("_m"))
    return df.join(means, g, "left").select(*[F.coalesce(F.col(col), F.col("_m")).alias(col) if c == col else F.col(c) for c in df.columns])


def _quality(held: DataFrame, of: DataFrame, metric: str, id_col: str, reps: int, seed: int, period: str | None) -> DataFrame:
    """Metric with bootstrap bounds on held-out rows (id, y, score, k); with ``period`` one row for each of them and one for 'all'."""
    if not period:
        return bootstrap_ci(held, ["k"], metric, [id_col], reps, seed).drop("k")
    each = held.drop("k").join(of.select(id_col, F.col(period).cast("string").alias("k")), id_col).filter("k is not null")
    both = cut_lineage(each.unionByName(held.withColumn("k", F.lit("all"))))
    # a period whose held-out rows are of one class has a row of NULLs
    return both.select("k").distinct().join(bootstrap_ci(both, ["k"], metric, [id_col], reps, seed), "k", "left").withColumnRenamed("k", period)


def impute_binary(df: DataFrame, col: str, cats: list[str], nums: list[str], id_col: str, seed: int = 1234,
                  reps: int = 20, period: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Model-impute a partly missing 0/1 column: fit on 90%, cut at the prevalence-balancing threshold.

    Returns (table with the column filled, AUROC on the held-out 10% with bootstrap bounds; with ``period`` for each and all).
    """
    known = holdout(df.filter(F.col(col).isin(0, 1)), 0.1, id_col, seed)
    train, test = known.filter("is_test = 0").drop("is_test"), known.filter("is_test = 1").drop("is_test")
    scored = cut_lineage(naive_bayes_stack(train, df.select(id_col, col, *cats, *nums), cats, nums, col, "_p"))
    held = scored.join(test.select(id_col), id_col, "left_semi").select(id_col, F.col(col).alias("y"), F.col("_p").alias("score"), F.lit(1).alias("k"))
    cut = threshold_balance(held, ["k"]).select("thresh").scalar()
    filled = df.join(scored.select(id_col, "_p"), id_col, "left").select(
        *[F.coalesce(F.col(c), (F.col("_p") >= cut).cast("int")).alias(c) if c == col else F.col(c) for c in df.columns])
    return filled, _quality(held, df, "auc", id_col, reps, seed, period)


def impute_numeric(df: DataFrame, col: str, cats: list[str], nums: list[str], id_col: str, seed: int = 1234,
                   reps: int = 20, period: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Model-impute a partly missing numeric column by averaged univariate regressions, with R-squared (for each ``period`` and all)."""
    known = holdout(df.filter(F.col(col).isNotNull()), 0.1, id_col, seed)
    table = univariate_fit(known.filter("is_test = 0"), cats, nums, col)
    scored = cut_lineage(univariate_scores(df.select(id_col, col, *cats, *nums), table, cats, nums, "_p"))
    test = known.filter("is_test = 1").select(id_col)
    held = scored.join(test, id_col, "left_semi").select(id_col, F.col(col).alias("y"), F.col("_p").alias("score"), F.lit(1).alias("k"))
    filled = df.join(scored.select(id_col, "_p"), id_col, "left").select(
        *[F.coalesce(F.col(c), F.col("_p")).alias(c) if c == col else F.col(c) for c in df.columns])
    return filled, _quality(held, df, "r2", id_col, reps, seed, period)


def gate_by_year(df: DataFrame, cols: list[str], period: str, cats: list[str], nums: list[str],
                 min_precision: float = 0.1, min_recall: float = 0.2) -> DataFrame:
    """Train on earlier periods, test on the next; a column passes when its mean precision and recall over
    the threshold grid and all test periods are high enough: name, auc, precision, recall, impute. What made df runs once:
    all fits read a written copy of the columns they need."""
    parts = []
    df = cut_spread(df.select(*dict.fromkeys([period, *cols, *cats, *nums])))
    for col in cols:  # a handful of columns
        known = df.filter(F.col(col).isin(0, 1))
        years = [r[0] for r in known.select(period).distinct().orderBy(period).collect()]
        for yr in years[1:]:
            s = naive_bayes_stack(known.filter(F.col(period) < yr), known.filter(F.col(period) == yr), cats, nums, col, "_p")
            s = cut_lineage(s.select(F.lit(col).alias("name"), F.lit(yr).alias("yr"), F.col(col).alias("y"), F.col("_p").alias("score")))
            grid = pr_grid(s, ["name", "yr"], 200).groupBy("name", "yr").agg(F.avg("precision").alias("precision"), F.avg("tpr").alias("recall"))
            parts.append(auc(s, ["name", "yr"]).select("name", "yr", "auc").join(grid, ["name", "yr"]))
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    mean = both.groupBy("name").agg(*[F.avg(c).alias(c) for c in ("auc", "precision", "recall")])
    return mean.withColumn("impute", ((F.col("precision") > min_precision) & (F.col("recall") > min_recall)).cast("int"))


def impute_multiclass(df: DataFrame, col: str, classes: list[str], cats: list[str], nums: list[str], id_col: str) -> DataFrame:
    """Fill a missing category: one balanced threshold per class, the class furthest above its own cut
    wins, and the first class stands in when none fires."""
    known = df.filter(F.col(col).isNotNull())
    margins = []
    out = df.select(id_col, col, *cats, *nums)
    for i, k in enumerate(classes[1:]):
        train = known.withColumn("_y", (F.col(col) == k).cast("bigint"))
        out = naive_bayes_stack(train, out, cats, nums, "_y", f"_p{i}")
        held = out.filter(F.col(col).isNotNull()).select((F.col(col) == k).cast("bigint").alias("y"), F.col(f"_p{i}").alias("score"), F.lit(1).alias("k"))
        out = cut_lineage(out.withColumn(f"_m{i}", F.col(f"_p{i}") - threshold_balance(held, ["k"]).select("thresh").scalar()))
        margins.append(F.struct(F.col(f"_m{i}").alias("m"), F.lit(k).alias("k")))
    top = F.greatest(*margins) if len(margins) > 1 else margins[0]
    pick = F.when(top["m"] > 0, top["k"]).otherwise(F.lit(classes[0]))
    return df.join(out.select(id_col, pick.alias("_pick")), id_col, "left").select(
        *[F.coalesce(F.col(c), F.col("_pick")).alias(c) if c == col else F.col(c) for c in df.columns])


def regression_impute(train: DataFrame, target: DataFrame, features: list[str], col: str, fold_col: str, lambdas: list[float] | None = None,
                      binary: bool = False) -> DataFrame:
    """Fill ``col`` of the target table by a cross-validated lasso; a 0/1 column is cut at the quantile of
    the training scores that keeps the training prevalence. Every row of the target stays; one with a NULL
    feature keeps its NULL."""
    path = lasso_cv(train, features, col, fold_col, lambdas=lambdas)
    fitted = path.predict(target, "_p")
    if not binary:
        return fitted.select(*[F.coalesce(F.col(c), F.col("_p")).alias(c) if c == col else F.col(c) for c in target.columns])
    prevalence = float(train.agg(F.avg(F.col(col).cast("double"))).first()[0])
    own = path.predict(train, "_p").filter(F.col("_p").isNotNull()).select("_p")
    cut = quantile_columns(own, [], "_p", {"q": 1 - prevalence}).select("q").scalar()
    return fitted.select(*[F.coalesce(F.col(c), (F.col("_p") >= cut).cast("int")).alias(c) if c == col else F.col(c) for c in target.columns])


def lasso_impute(train: DataFrame, target: DataFrame, nums: list[str], cats: list[str], col: str, fold_col: str, id_col: str, binary: bool = False,
                 held: float = 0.1, seed: int = 1234) -> tuple[DataFrame, DataFrame]:
    """Fill ``col`` of the target table by a cross-validated lasso on numbers and one-hot levels.

    A tenth of the training rows (by id) is held out of the fit and gives the quality: (col, metric, value), R-squared of
    a number, AUROC of a 0/1 column. A 0/1 column is cut at the quantile of the training scores that keeps the training
    prevalence. Every row of the target stays; a NULL or unseen level counts as none; beside a NULL number the NULL stays.
    """
    known = holdout(train.filter(F.col(col).isNotNull()), held, id_col, seed, "_held")
    fitted, test = known.filter("_held = 0"), known.filter("_held = 1")
    path = lasso_cv(fitted, nums, col, fold_col, cats)
    scored = path.predict(target, "_p")
    checked = path.predict(test, "_p").filter(F.col("_p").isNotNull()).select(F.col(col).cast("double").alias("y"), "_p")
    if binary:
        value = auc(checked.withColumn("y", F.col("y").cast("bigint")), [], "y", "_p").select(F.col("auc").alias("value"))
        prevalence = float(fitted.agg(F.avg(F.col(col).cast("double"))).first()[0])
        cut = quantile_columns(path.predict(fitted, "_p").filter(F.col("_p").isNotNull()), [], "_p", {"q": 1 - prevalence}).select("q").scalar()
        fill = (F.col("_p") >= cut).cast(target.schema[col].dataType)
    else:
        value = checked.agg((1 - div(F.sum((F.col("y") - F.col("_p")) ** 2), F.count("y") * F.var_pop("y"))).alias("value"))
        fill = F.col("_p").cast(target.schema[col].dataType)
    quality = value.select(F.lit(col).alias("col"), F.lit("auc" if binary else "r2").alias("metric"), "value")
    return scored.select(*[F.coalesce(F.col(c), fill).alias(c) if c == col else F.col(c) for c in target.columns]), quality
