"""Model fits as Spark jobs (section 2.L).

Fits that exist in Spark ML use it. Fits per group run for all groups at once: every Newton step is one
aggregation of the weighted moments by group, so a hot group is summed in parallel like any other and
only moments (size p by p) meet in one place. Feature counts are small there (moments are written out as
aggregates); wide pooled designs go through Spark ML.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.dist import norm_cdf
from ..session import cut_lineage, cut_spread
from .features import permute
from .inference import fdr
from .joins import sample_pairs
from .paths import sqrt_lasso_stop
from .ranking import auc, div

#: Newton steps at most, and the largest change of a coefficient at which they end.
ITERATIONS, TOLERANCE = 25, 1e-9
#: Features beyond which a discriminant is no longer written out as an expression.
WIDE = 16
#: Groups up to which a table of coefficients goes to every task.
FEW_GROUPS = 10_000


# --- one model on all rows (L1-L3, L19) -----------------------------------------------------------

def _assembled(features: list[str], stage) -> Pipeline:
    """Rows are never dropped when scoring; fits take the rows without a NULL feature (``_known``)."""
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep"), stage])


def _known(df: DataFrame, features: list[str], y: str) -> DataFrame:
    """Rows with a 0/1 label and all features."""
    return df.filter(F.col(y).isin(0, 1)).dropna(subset=features)


def fit_logistic(df: DataFrame, features: list[str], y: str = "y", c: float = 1.0, n: int | None = None) -> PipelineModel:
    """L2 logistic regression; regParam = 1 / (c * rows), unstandardised. The intercept is not penalised."""
    known = _known(df, features, y)
    rows = n or known.count()
    est = LogisticRegression(labelCol=y, regParam=1.0 / (c * max(rows, 1)), elasticNetParam=0.0, standardization=False, maxIter=50)
    return _assembled(features, est).fit(known)


def fit_forest(df: DataFrame, features: list[str], y: str = "y", depth: int = 5, trees: int = 20, seed: int = 1) -> PipelineModel:
    est = RandomForestClassifier(labelCol=y, maxDepth=depth, numTrees=trees, seed=seed)
    return _assembled(features, est).fit(_known(df, features, y))


def fit_boosted(df: DataFrame, features: list[str], y: str = "y", depth: int = 3, rounds: int = 10,
                columns: str = "all", seed: int = 1) -> PipelineModel:
    """Gradient-boosted trees; ``columns`` is the share of columns tried per node."""
    est = GBTClassifier(labelCol=y, maxDepth=depth, maxIter=rounds, featureSubsetStrategy=columns, seed=seed)
    return _assembled(features, est).fit(_known(df, features, y))


FITS = {"logit": fit_logistic, "rf": fit_forest, "gbt": fit_boosted}


def score(model: PipelineModel, df: DataFrame, out: str = "preds") -> DataFrame:
    """Probability of the event for every row; NULL where a feature is NULL."""
    scored = model.transform(df)
    missing = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in model.stages[0].getInputCols()])
    return scored.select(*df.columns, F.when(~missing, vector_to_array("probability")[1]).alias(out))


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


# --- folds, grids (L4, L7, L8) --------------------------------------------------------------------

def fit_folds(df: DataFrame, folds: list, labels: list[str], features: list[str], kind: str = "logit",
              params: dict | None = None, parallel: int = 4) -> tuple[DataFrame, DataFrame]:
    """Per label and fold: train, validate, refit on train and validation, score the test period.

    df carries fold and role (see expanding_folds), one set of folds for all labels. Returns (test
    scores, validation AUROCs). The driver loops over fits, never over rows; ``parallel`` fits share the
    cluster. What made df runs once: all fits read a written copy.
    """
    params = params or {}
    fit = FITS[kind]
    # trees draw their samples by partition, so their rows stay where they are
    df = cut_spread(df) if kind == "logit" else cut_lineage(df)

    def one(job):
        label, fold = job
        part = df.filter(F.col("fold") == fold).withColumn("y", F.col(label).cast("double"))
        seen = part.filter(F.col("role") != "test")
        test = score(fit(seen, features, "y", **params), part.filter(F.col("role") == "test"))
        tag = [F.lit(label).alias("outcome"), F.lit(kind).alias("model"), F.lit("agg").alias("method")]
        test = test.select("*", *tag)
        valid = None
        if part.filter(F.col("role") == "valid").limit(1).count():
            first = fit(part.filter(F.col("role") == "train"), features, "y", **params)
            v = score(first, part.filter(F.col("role") == "valid"))
            valid = auc(v, ["fold"], "y", "preds").select("fold", F.lit(label).alias("outcome"), F.lit(kind).alias("model"), "auc")
        return test, valid

    with ThreadPoolExecutor(parallel) as pool:
        results = list(pool.map(one, [(lb, fo) for lb in labels for fo in folds]))
    tests = reduce(DataFrame.unionByName, [r[0] for r in results])
    valids = [r[1] for r in results if r[1] is not None]
    return tests, reduce(DataFrame.unionByName, valids) if valids else None


def grid_search(df: DataFrame, features: list[str], fold_col: str, grid: list[float], k: int, y: str = "y",
                parallel: int = 4) -> tuple[PipelineModel, list[tuple[float, float]]]:
    """Cross-validated choice of the ridge penalty on given folds, refitted on all rows. All fits read one written copy of
    the columns they need."""
    known = cut_spread(_known(df, features, y).select(*features, y, F.col(fold_col).cast("int").alias(fold_col)))

    def make(reg: float) -> Pipeline:
        return _assembled(features, LogisticRegression(labelCol=y, elasticNetParam=0.0, maxIter=30, regParam=reg))

    def checked(job) -> float:
        reg, fold = job
        v = make(reg).fit(known.filter(F.col(fold_col) != fold)).transform(known.filter(F.col(fold_col) == fold))
        m = auc(v.select(y, vector_to_array("rawPrediction")[1].alias("_raw")), [], y, "_raw").first()
        if m is None or not (m["n1"] or m["n0"]):
            raise ValueError(f"no rows in fold {fold}")
        return float(m["n1"] > 0) if m["auc"] is None else m["auc"]  # one class: the area of the curve's remaining corner

    with ThreadPoolExecutor(parallel) as pool:
        found = np.array(list(pool.map(checked, [(reg, fold) for reg in grid for fold in range(k)]))).reshape(len(grid), k).mean(axis=1)
    return make(grid[int(found.argmax())]).fit(known), list(zip(grid, found.tolist()))


def best_params(validation: DataFrame, keys: list[str], params: list[str], metric: str = "auc") -> DataFrame:
    """Parameters with the highest validation metric per keys; ties: smallest parameters."""
    at = F.struct((-F.round(metric, 12)).alias("m"), *params)
    return (validation.filter(F.col(metric).isNotNull()).groupBy(*keys)
            .agg(F.min(F.struct(at.alias("at"), F.col(metric).alias("v"))).alias("_b"))
            .select(*keys, *[F.col(f"_b.at.{p}").alias(p) for p in params], F.col("_b.v").alias(metric)))


# --- one model per group (L5, L6, L14, L16) ----------------------------------------------------------

def _solve(hess: np.ndarray, grad: np.ndarray) -> np.ndarray:
    try:
        return np.linalg.solve(hess, grad)
    except np.linalg.LinAlgError:
        return np.linalg.lstsq(hess, grad, rcond=None)[0]


def _unpack(upper, p):
    full = np.zeros((p, p))
    full[np.triu_indices(p)] = upper
    return full + np.triu(full, 1).T


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _newton_step(beta: pd.Series, upper: pd.Series, grad: pd.Series, ridge: pd.Series) -> pd.Series:
    """beta + H^-1 g; the ridge spares the intercept, a tiny one keeps separated groups solvable."""
    out = []
    for b, u, g, r in zip(beta, upper, grad, ridge):
        b, g = np.asarray(b, float), np.asarray(g, float)
        penalty = np.full(len(b), r)
        penalty[0] = 0.0
        step = _solve(_unpack(np.asarray(u, float), len(b)) + np.diag(penalty + 1e-8), g - penalty * b)
        out.append((b + np.clip(step, -5, 5)).tolist())
    return pd.Series(out)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _standard_errors(upper: pd.Series, p: pd.Series) -> pd.Series:
    out = []
    for u, k in zip(upper, p):
        inv = np.linalg.pinv(_unpack(np.asarray(u, float), int(k)))
        out.append(np.sqrt(np.maximum(np.diag(inv), 0)).tolist())
    return pd.Series(out)


def linear_predictor(features: list[str], beta: str = "beta") -> Column:
    """beta[0] + sum beta[i] x_i."""
    return reduce(lambda a, b: a + b, [F.col(beta)[i + 1] * F.col(c) for i, c in enumerate(features)], F.col(beta)[0])


def _moments(df: DataFrame, keys: list[str], features: list[str], weight: Column, resid: Column) -> DataFrame:
    x = [F.lit(1.0), *[F.col(c).cast("double") for c in features]]
    p = len(x)
    d = df.select(*keys, *features, weight.alias("_w"), resid.alias("_r"))
    w = F.col("_w")
    upper = [F.sum(w * x[i] * x[j]).alias(f"_h{i}_{j}") for i in range(p) for j in range(i, p)]
    grad = [F.sum(x[i] * F.col("_r")).alias(f"_g{i}") for i in range(p)]
    sums = d.groupBy(*keys).agg(*upper, *grad)
    return sums.select(*keys, F.array(*[f"_h{i}_{j}" for i in range(p) for j in range(i, p)]).alias("_upper"),
                       F.array(*[f"_g{i}" for i in range(p)]).alias("_grad"))


def _beside(df: DataFrame, coef: DataFrame, keys: list[str]) -> DataFrame:
    """Rows beside their group's coefficients (a written table). A counted small table goes to every task: a shuffle by the
    keys would make one task of a group with half of the rows."""
    few = coef.select(*keys).limit(FEW_GROUPS + 1).count() <= FEW_GROUPS
    return df.join(F.broadcast(coef) if few else coef, keys)


def fit_grouped_logit(df: DataFrame, keys: list[str], features: list[str], y: str = "y", ridge: float = 1.0,
                      iterations: int = ITERATIONS) -> DataFrame:
    """keys, n1, n0, beta (intercept first), se. Groups with one class get no row.

    One aggregation job per Newton step for all groups together, until no coefficient moves by TOLERANCE or ``iterations``
    are done. The pruned design is checkpointed once
    (every step reads it), the coefficient table (one small row per group) after each step and at the end.
    """
    df = cut_spread(df.filter(F.col(y).isin(0, 1)).select(*keys, *features, y))
    size = df.groupBy(*keys).agg(F.sum((F.col(y) == 1).cast("bigint")).alias("n1"), F.sum((F.col(y) == 0).cast("bigint")).alias("n0"))
    size = size.filter((F.col("n1") > 0) & (F.col("n0") > 0))
    zeros = [F.ln(F.col("n1") / F.col("n0"))] + [F.lit(0.0)] * len(features)
    coef = cut_lineage(size.select(*keys, "n1", "n0", F.array(*zeros).alias("beta")))
    p = len(features) + 1
    mu = 1.0 / (1.0 + F.exp(-linear_predictor(features)))
    for _ in range(iterations):
        rows = _beside(df, coef.select(*keys, "beta"), keys).withColumn("_mu", mu)
        mom = _moments(rows, keys, features, F.col("_mu") * (1 - F.col("_mu")), F.col(y) - F.col("_mu"))
        stepped = coef.join(mom, keys).select(*keys, "n1", "n0", F.col("beta").alias("_old"), _newton_step("beta", "_upper", "_grad", F.lit(ridge)).alias("beta"))
        stepped = cut_lineage(stepped.withColumn("_move", F.array_max(F.zip_with("beta", "_old", lambda a, b: F.abs(a - b)))).drop("_old"))
        coef = stepped.drop("_move")
        if (stepped.agg(F.max("_move")).first()[0] or 0.0) < TOLERANCE:
            break
    rows = _beside(df, coef.select(*keys, "beta"), keys).withColumn("_mu", mu)
    mom = _moments(rows, keys, features, F.col("_mu") * (1 - F.col("_mu")), F.col(y) - F.col("_mu"))
    return cut_lineage(coef.join(mom, keys).select(*keys, "n1", "n0", "beta", _standard_errors("_upper", F.lit(p)).alias("se")))


def score_grouped(df: DataFrame, coef: DataFrame, keys: list[str], features: list[str], out: str = "preds") -> DataFrame:
    """Scores of the rows whose group has a model."""
    d = _beside(df, coef.select(*keys, "beta"), keys)
    return d.withColumn(out, 1.0 / (1.0 + F.exp(-linear_predictor(features)))).drop("beta")


def fit_by_group(df: DataFrame, g: list[str], features: list[str], y: str = "y", ridge: float = 1.0,
                 iterations: int = ITERATIONS) -> DataFrame:
    """Sub-models: one logistic model per (fold, group), scores on each fold's test period.

    df carries fold and role; a group without both classes in training is skipped.
    """
    keys = ["fold", *g]
    coef = fit_grouped_logit(df.filter(F.col("role") != "test"), keys, features, y, ridge, iterations)
    return score_grouped(df.filter(F.col("role") == "test"), coef, keys, features).withColumn("method", F.lit("sub"))


def logit_inference(df: DataFrame, keys: list[str], features: list[str], y: str = "y") -> DataFrame:
    """Coefficients with Wald p-values per keys (unpenalised): keys, feature, coef, se, z, pval."""
    fit = fit_grouped_logit(df, keys, features, y, ridge=0.0)
    cells = F.explode(F.arrays_zip(F.array(*[F.lit(f) for f in ["intercept", *features]]).alias("feature"),
                                   F.col("beta"), F.col("se"))).alias("_c")
    out = fit.select(*keys, cells).select(*keys, F.col("_c.feature").alias("feature"), F.col("_c.beta").alias("coef"), F.col("_c.se").alias("se"))
    out = out.withColumn("z", div(F.col("coef"), F.col("se")))
    return out.withColumn("pval", 2 * (1 - norm_cdf(F.abs(F.col("z")))))


# --- naive Bayes and averaged regressions (L9, L10, L28) -----------------------------------------------

def bernoulli_table(train: DataFrame, cats: list[str], y: str = "y") -> tuple[DataFrame, dict[int, float]]:
    """Per (name, level): log odds parts of the Bernoulli model with Laplace 1; and the class totals.

    on: change of the log odds when the level is present; off: its share when absent.
    """
    n = train.filter(F.col(y).isin(0, 1)).groupBy(y).agg(F.count(F.lit(1)).alias("n")).collect()
    tot = {int(r[y]): float(r["n"]) for r in n}
    long = (train.filter(F.col(y).isin(0, 1)).select(y, *[F.col(c).cast("string").alias(c) for c in cats])
            .unpivot([y], cats, "name", "level").filter(F.col("level").isNotNull()))
    counts = long.groupBy("name", "level").agg(F.sum(F.when(F.col(y) == 1, 1.0).otherwise(0.0)).alias("c1"),
                                               F.sum(F.when(F.col(y) == 0, 1.0).otherwise(0.0)).alias("c0"))
    p1 = (F.col("c1") + 1) / (tot.get(1, 0.0) + 2)
    p0 = (F.col("c0") + 1) / (tot.get(0, 0.0) + 2)
    return counts.select("name", "level", (F.ln(p1 / (1 - p1)) - F.ln(p0 / (1 - p0))).alias("on"),
                         (F.ln(1 - p1) - F.ln(1 - p0)).alias("off")), tot


def bernoulli_scores(df: DataFrame, table: DataFrame, tot: dict[int, float], cats: list[str], out: str = "p_bern") -> DataFrame:
    """Probability of the event; unseen levels count as absent everywhere."""
    table = cut_lineage(table)
    base = table.agg(F.sum("off")).scalar()
    d = df.withColumn("_eta", base + float(np.log(tot[1] / tot[0])))
    for c in cats:  # schema-sized loop; each table is small and broadcast by its size
        part = table.filter(F.col("name") == c).select(F.col("level").alias(f"_l_{c}"), F.col("on").alias(f"_on_{c}"))
        d = d.join(part, F.col(c).cast("string") == F.col(f"_l_{c}"), "left")
    eta = reduce(lambda a, b: a + b, [F.coalesce(F.col(f"_on_{c}"), F.lit(0.0)) for c in cats], F.col("_eta"))
    return d.withColumn(out, 1.0 / (1.0 + F.exp(-eta))).select(*df.columns, out)


def gaussian_scores(df: DataFrame, train: DataFrame, nums: list[str], y: str = "y", out: str = "p_gauss") -> DataFrame:
    """Gaussian naive Bayes from class means and variances (one aggregation). A NULL feature adds nothing to either class."""
    known = train.filter(F.col(y).isin(0, 1))
    stats = {int(r[y]): r for r in known.groupBy(y).agg(F.count(F.lit(1)).alias("n"), *[
        f(c).alias(f"{k}_{c}") for c in nums for k, f in (("m", F.avg), ("v", F.var_pop))]).collect()}
    spread = max(float(stats[k][f"v_{c}"] or 0) for k in (0, 1) for c in nums)
    eta = F.lit(float(np.log(stats[1]["n"] / stats[0]["n"])))
    for c in nums:
        for k, sign in ((1, 1.0), (0, -1.0)):
            m, v = float(stats[k][f"m_{c}"]), float(stats[k][f"v_{c}"]) + 1e-9 * spread
            eta = eta + F.coalesce(sign * (-0.5 * float(np.log(v)) - (F.col(c) - m) ** 2 / (2 * v)), F.lit(0.0))
    return df.withColumn(out, 1.0 / (1.0 + F.exp(-eta)))


def naive_bayes_stack(train: DataFrame, df: DataFrame, cats: list[str], nums: list[str], y: str = "y",
                      out: str = "preds") -> DataFrame:
    """Bernoulli and Gaussian naive Bayes combined by a logistic regression on their probabilities."""
    table, tot = bernoulli_table(train, cats, y)
    table = cut_lineage(table)

    def both(x):
        return gaussian_scores(bernoulli_scores(x, table, tot, cats), train, nums, y)

    stack = _assembled(["p_bern", "p_gauss"], LogisticRegression(labelCol=y, regParam=0.0, maxIter=50)).fit(
        both(train).withColumn(y, F.col(y).cast("double")))
    return score(stack, both(df), out).drop("p_bern", "p_gauss")


def univariate_table(design: DataFrame, total_n: Column, total_y: Column, total_yy: Column, alpha: float = 0.1) -> DataFrame:
    """Per feature OLS of y on x from sums over the design.

    design: name, sx, sxx, sxy (zeros add nothing, so sparse rows suffice). Returns name, b0, b1, r2,
    pval, fdr, weight (R-squared where the adjusted p is below alpha, else 0).
    """
    n, sy, syy = total_n.cast("double"), total_y.cast("double"), total_yy.cast("double")
    # the feature table is small; it is checkpointed where later expressions would repeat earlier ones
    d = design.select("name", "sx", "sxx", "sxy", n.alias("n"), sy.alias("sy"), syy.alias("syy"))
    n, sy, syy = F.col("n"), F.col("sy"), F.col("syy")
    d = cut_lineage(d.withColumn("b1", div(n * F.col("sxy") - F.col("sx") * sy, n * F.col("sxx") - F.col("sx") * F.col("sx"))))
    d = d.withColumn("b0", (sy - F.col("b1") * F.col("sx")) / n)
    d = cut_lineage(d.withColumn("s2", (syy - F.col("b0") * sy - F.col("b1") * F.col("sxy")) / (n - 2)))
    d = d.withColumn("r2", F.greatest(F.lit(0.0), 1 - F.col("s2") / (syy / n - (sy / n) ** 2)))
    se = F.sqrt(div(F.col("s2") * n, n * F.col("sxx") - F.col("sx") * F.col("sx")))
    d = d.withColumn("pval", F.when(F.col("r2") > 0, 2 * (1 - norm_cdf(F.abs(F.col("b1") / se)))).otherwise(1.0))
    adjusted = fdr(d.filter("r2 > 0").withColumn("_k", F.lit(1)), ["_k"], "pval", "name").drop("_k")
    rest = d.filter("r2 = 0 or r2 is null").withColumn("fdr", F.lit(1.0))
    both = adjusted.unionByName(rest)
    return both.select("name", "b0", "b1", "r2", "pval", "fdr", F.when(F.col("fdr") < alpha, F.col("r2")).otherwise(0.0).alias("weight"))


def design_sums(df: DataFrame, cats: list[str], nums: list[str], y: str) -> DataFrame:
    """name, sx, sxx, sxy over one-hot levels 'col=level' and numeric columns."""
    yv = F.col(y).cast("double")
    parts = [F.struct(F.concat(F.lit(f"{c}="), F.col(c).cast("string")).alias("name"), F.lit(1.0).alias("x")) for c in cats]
    parts += [F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("x")) for c in nums]
    long = df.select(yv.alias("_y"), F.explode(F.array(*parts)).alias("_f")).select("_y", "_f.*").filter("name is not null and x is not null")
    return long.groupBy("name").agg(F.sum("x").alias("sx"), F.sum(F.col("x") * F.col("x")).alias("sxx"), F.sum(F.col("x") * F.col("_y")).alias("sxy"))


def univariate_fit(train: DataFrame, cats: list[str], nums: list[str], y: str, alpha: float = 0.1) -> DataFrame:
    """Averaged univariate regressions: the feature table."""
    tot = train.agg(F.struct(F.count(y).alias("n"), F.sum(F.col(y).cast("double")).alias("y"),
                             F.sum(F.col(y).cast("double") * F.col(y)).alias("yy")).alias("t")).scalar()
    design = design_sums(train, cats, nums, y).withColumn("_t", tot)
    return univariate_table(design, F.col("_t.n"), F.col("_t.y"), F.col("_t.yy"), alpha)


def univariate_scores(df: DataFrame, table: DataFrame, cats: list[str], nums: list[str], out: str = "eta") -> DataFrame:
    """Weighted average of the univariate predictions over a row's non-zero features; a NULL feature counts as zero."""
    table = cut_lineage(table.filter("weight > 0").select("name", "b0", "b1", "weight"))
    d = df.withColumn("_b0", table.agg(div(F.sum(F.col("b0") * F.col("weight")), F.sum("weight"))).scalar())
    num, den = F.lit(0.0), F.lit(0.0)
    for c in [*cats, *nums]:  # schema-sized loop; each table is small and broadcast by its size
        if c in cats:
            x, key = F.lit(1.0), F.concat(F.lit(f"{c}="), F.col(c).cast("string"))
            part = table.filter(F.col("name").startswith(f"{c}="))
        else:
            x, key = F.col(c).cast("double"), F.lit(c)
            part = table.filter(F.col("name") == c)
        d = d.join(part.select(F.col("name").alias(f"_n_{c}"), F.col("b1").alias(f"_b_{c}"), F.col("weight").alias(f"_w_{c}")),
                   key == F.col(f"_n_{c}"), "left")
        w = F.when(x != 0, F.coalesce(F.col(f"_w_{c}"), F.lit(0.0))).otherwise(0.0)
        num = num + w * (F.coalesce(x, F.lit(0.0)) * F.coalesce(F.col(f"_b_{c}"), F.lit(0.0)) + F.col("_b0"))
        den = den + w
    return d.withColumn(out, div(num, den)).select(*df.columns, out)


def group_baseline(df: DataFrame, g: str, y: str = "y", smooth: float = 1.0) -> DataFrame:
    """Smoothed event rate of the group in each fold's training periods, as the test score."""
    train = df.filter((F.col("role") != "test") & F.col(y).isin(0, 1))
    rates = train.groupBy("fold", g).agg(((F.sum(y) + smooth) / (F.count(F.lit(1)) + 2 * smooth)).alias("phat"))
    return df.filter(F.col("role") == "test").join(rates, ["fold", g])


# --- moments and paths (L11-L13, L16, L17) ---------------------------------------------------------------

def gram(df: DataFrame, features: list[str], targets: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """X'X (with intercept), X'Y, column sums of Y squared and n, summed by the cluster.

    Each task adds up its own rows; what is merged is p by p, whatever the number of rows.
    """
    p, q = len(features) + 1, len(targets)
    cols = [F.col(c).cast("double").alias(c) for c in dict.fromkeys([*features, *targets])]

    def partial(batches):
        xx, xy, yy, n = np.zeros((p, p)), np.zeros((p, q)), np.zeros(q), 0.0
        for pdf in batches:
            pdf = pdf.dropna()
            x = np.column_stack([np.ones(len(pdf)), pdf[features].to_numpy(float)])
            t = pdf[targets].to_numpy(float)
            xx, xy, yy, n = xx + x.T @ x, xy + x.T @ t, yy + (t * t).sum(0), n + len(pdf)
        flat = np.concatenate([xx.ravel(), xy.ravel(), yy, [n]])
        yield pd.DataFrame({"i": np.arange(len(flat)), "v": flat})

    rows = df.select(*cols).mapInPandas(partial, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()
    flat = np.array([r["v"] for r in rows])
    a, b = p * p, p * p + p * q
    return flat[:a].reshape(p, p), flat[a:b].reshape(p, q), flat[b:b + q], float(flat[-1])


def linear_score(features: list[str], beta, out_expr: Column | None = None) -> Column:
    return reduce(lambda a, b: a + b, [float(w) * F.col(c) for w, c in zip(beta[1:], features)], F.lit(float(beta[0])))


def ridge_path(train: DataFrame, valid: DataFrame, features: list[str], y: str, lambdas: list[float]) -> tuple[np.ndarray, list[tuple[float, float]]]:
    """Ridge over a decreasing path from one pass over the rows; stops once validation R-squared falls."""
    xx, xy, _, _ = gram(train, features, [y])
    vx, vy, vyy, vn = gram(valid, features, [y])
    best, history, last = None, [], -np.inf
    mean = vy[0, 0] / vn
    sst = vyy[0] - vn * mean * mean
    for lam in sorted(lambdas, reverse=True):
        pen = np.diag([0.0] + [lam] * len(features))
        beta = _solve(xx + pen, xy[:, 0])
        r2 = 1 - (vyy[0] - 2 * beta @ vy[:, 0] + beta @ vx @ beta) / sst
        history.append((lam, float(r2)))
        if r2 < last:
            break
        best, last = beta, r2
    return best, history


def sparse_precision(cov: np.ndarray, penalty: float, tol: float = 1e-7, rounds: int = 500, sweeps: int = 1000) -> tuple[np.ndarray, np.ndarray]:
    """(covariance, precision) that maximise log det P - tr(cov P) - penalty * sum of |P_ij| off the diagonal.

    Block coordinate descent: in turn each column of the covariance is refitted by a lasso of its variable on the others,
    solved by coordinate descent from the column's last solution.
    """
    p = len(cov)
    w = 0.95 * cov
    w[np.diag_indices(p)] = np.diag(cov)
    b = np.zeros((p, p))  # column j: coefficients of variable j on the others, b[j, j] = 0
    scale = max(float(np.abs(cov).mean()), 1e-300)
    for _ in range(rounds):
        before = w.copy()
        for j in range(p):
            beta, rest = b[:, j], np.delete(np.arange(p), j)
            grad = cov[:, j] - w @ beta  # of the smooth part, at every variable
            for _ in range(sweeps):
                most = 0.0
                for i in rest:
                    z = grad[i] + w[i, i] * beta[i]
                    new = np.sign(z) * max(abs(z) - penalty, 0.0) / w[i, i]
                    step = new - beta[i]
                    if step:
                        beta[i] = new
                        grad -= w[:, i] * step
                        most = max(most, abs(step) * w[i, i])
                if most < tol * scale:
                    break
            column = (w @ beta)[rest]
            w[rest, j] = w[j, rest] = column
        if np.abs(w - before).max() < tol * scale:
            break
    prec = np.zeros((p, p))
    for j in range(p):
        prec[j, j] = 1 / (w[j, j] - w[:, j] @ b[:, j])
        prec[:, j] -= b[:, j] * prec[j, j]
    return w, (prec + prec.T) / 2


def class_moments(train: DataFrame, features: list[str], label: str) -> dict:
    """{class: (rows, means, covariance)} of the rows without a NULL, from one pass; a class without such rows is left out."""
    p = len(features)
    cols = [F.col(c).cast("double").alias(c) for c in features]

    def partial(batches):
        sums = {}
        for pdf in batches:
            pdf = pdf.dropna()
            for k, part in pdf.groupby(label):
                x = np.column_stack([np.ones(len(part)), part[features].to_numpy(float)])
                sums[k] = sums.get(k, 0) + x.T @ x
        for k, m in sums.items():
            yield pd.DataFrame({"k": k, "i": np.arange(m.size), "v": m.ravel()})

    kind = train.schema[label].dataType.simpleString()
    rows = train.select(label, *cols).mapInPandas(partial, f"k {kind}, i long, v double").groupBy("k", "i").agg(F.sum("v").alias("v")).collect()
    mats: dict = {}
    for r in rows:
        mats.setdefault(r["k"], np.zeros((p + 1) ** 2))[r["i"]] = r["v"]
    out = {}
    for k in sorted(mats):
        m = mats[k].reshape(p + 1, p + 1)
        n, mu = m[0, 0], m[0, 1:] / m[0, 0]
        out[k] = n, mu, (m[1:, 1:] - n * np.outer(mu, mu)) / max(n - 1, 1)
    return out


def sparse_precisions(spark: SparkSession, covs: dict, penalty: float) -> dict:
    """{class: sparse precision}; the classes are solved side by side, one task each."""
    keys = list(covs)

    def solve(batches):
        for pdf in batches:
            for i, cov in zip(pdf["i"], pdf["v"]):
                p = int(len(cov) ** 0.5)
                yield pd.DataFrame({"i": [i], "v": [sparse_precision(np.asarray(cov, float).reshape(p, p), penalty)[1].ravel().tolist()]})

    sent = spark.createDataFrame([(i, covs[k].ravel().tolist()) for i, k in enumerate(keys)], "i int, v array<double>").repartition(len(keys), "i")
    return {keys[r["i"]]: np.asarray(r["v"]).reshape(covs[keys[r["i"]]].shape) for r in sent.mapInPandas(solve, "i int, v array<double>").collect()}


def discriminant(train: DataFrame, df: DataFrame, features: list[str], label: str, kind: str = "lda", shrink: float = 1e-6,
                 out: str = "pred", penalty: float | None = None) -> DataFrame:
    """LDA or QDA from class moments; adds the most probable class and its log density.

    Class moments come from one pass on the cluster; solving p by p is local. More than WIDE features
    are scored in Arrow batches, fewer as column arithmetic. ``penalty`` (QDA): each class takes a sparse precision matrix
    by the graphical lasso instead of the inverse covariance. Classes without a complete row are never predicted; without
    any class, and beside a NULL feature, both columns are NULL.
    """
    stats = class_moments(train, features, label)
    p, kind_sql = len(features), train.schema[label].dataType.simpleString()
    if not stats:
        return df.withColumn(out, F.lit(None).cast(kind_sql)).withColumn(f"{out}_logp", F.lit(None).cast("double"))
    total = sum(n for n, _, _ in stats.values())
    pooled = sum(cov * max(n - 1, 1) for n, _, cov in stats.values()) / max(total - len(stats), 1)
    sigma = {k: (pooled if kind == "lda" else cov) + shrink * np.eye(p) for k, (_, _, cov) in stats.items()}
    if penalty is not None and kind == "qda":
        root = {k: np.linalg.cholesky(m) for k, m in sparse_precisions(train.sparkSession, sigma, penalty).items()}
    else:
        root = {k: np.linalg.cholesky(np.linalg.inv(m)) for k, m in sigma.items()}
    # the density of a class: const - |root' (x - mu)|^2 / 2
    const = {k: float(np.log(stats[k][0] / total) + np.log(np.diag(root[k])).sum()) for k in stats}
    if p > WIDE:
        factors = {k: (const[k], stats[k][1], root[k]) for k in stats}

        @F.pandas_udf(f"logp double, k {kind_sql}")
        def densest(xs: pd.Series) -> pd.DataFrame:
            logp, cls = np.full(len(xs), np.nan), np.full(len(xs), None, object)
            known = [i for i, x in enumerate(xs) if x is not None and not pd.isna(x).any()]
            if known:
                x = np.array([np.asarray(xs.iloc[i], float) for i in known])
                each = np.stack([c - 0.5 * (((x - mu) @ low) ** 2).sum(axis=1) for c, mu, low in factors.values()])
                logp[known], cls[known] = each.max(axis=0), np.array(list(factors), object)[each.argmax(axis=0)]
            return pd.DataFrame({"logp": pd.Series(logp).where(np.isfinite(logp), None), "k": pd.Series(cls)})

        best = densest(F.array(*[F.col(c).cast("double") for c in features]))
        return df.withColumn("_best", best).withColumn(out, F.col("_best.k")).withColumn(f"{out}_logp", F.col("_best.logp")).drop("_best")
    best = None
    for k in stats:
        mu, low = stats[k][1], root[k]
        quad = F.lit(0.0)
        for j in range(p):  # |root' (x - mu)|^2, written out as column arithmetic
            part = reduce(lambda a, b: a + b, [float(low[i, j]) * (F.col(features[i]) - float(mu[i])) for i in range(j, p)])
            quad = quad + part * part
        logp = F.lit(const[k]) - 0.5 * quad
        cell = F.when(logp.isNotNull(), F.struct(logp.alias("logp"), F.lit(k).alias("k")))
        best = cell if best is None else F.greatest(best, cell)
    return df.withColumn("_best", best).withColumn(out, F.col("_best.k")).withColumn(f"{out}_logp", F.col("_best.logp")).drop("_best")


def lasso_path(df: DataFrame, features: list[str], y: str, fold_col: str, k: int, lambdas: list[float]) -> tuple[PipelineModel, float, list[tuple[float, float, float]]]:
    """Logistic lasso over a penalty grid with given folds; the largest penalty within one SE of the best is refitted.
    Linear targets take ``paths.lasso_cv``, which needs one pass for all penalties and folds.

    Returns (model, chosen penalty, [(penalty, mean error, se)]). Rows with a NULL feature or target are not fitted.
    """
    df = df.dropna(subset=[*features, y])

    def make(lam):
        return _assembled(features, LogisticRegression(labelCol=y, elasticNetParam=1.0, regParam=lam, maxIter=50))

    def error(job):
        lam, fold = job
        m = make(lam).fit(df.filter(F.col(fold_col) != fold)).transform(df.filter(F.col(fold_col) == fold))
        return m.agg(F.avg((F.col(y) - vector_to_array("probability")[1]) ** 2)).first()[0]

    jobs = [(lam, f) for lam in lambdas for f in range(k)]
    with ThreadPoolExecutor(4) as pool:
        errors = np.array(list(pool.map(error, jobs))).reshape(len(lambdas), k)
    mean, se = errors.mean(1), errors.std(1, ddof=1) / np.sqrt(k)
    best = int(mean.argmin())
    chosen = max(lam for lam, m in zip(lambdas, mean) if m <= mean[best] + se[best])
    return make(chosen).fit(df), chosen, list(zip(lambdas, mean.tolist(), se.tolist()))


def multi_output_logit(df: DataFrame, features: list[str], labels: list[str], ids: list[str], ridge: float = 1.0) -> DataFrame:
    """Linear fit of all labels on shared moments, then a two-parameter logistic calibration per label.

    Returns ids, label, y, eta, preds. The needed columns are written once; moments, calibration and scores read them.
    """
    df = cut_spread(df.select(*dict.fromkeys([*ids, *features, *labels])))
    xx, xy, _, _ = gram(df, features, labels)
    betas = _solve(xx + ridge * np.diag([0.0] + [1.0] * len(features)), xy)
    cells = F.array(*[F.struct(F.lit(lb).alias("label"), F.col(lb).cast("bigint").alias("y"), linear_score(features, betas[:, i]).alias("eta"))
                      for i, lb in enumerate(labels)])
    long = df.select(*ids, F.explode(cells).alias("_c")).select(*ids, "_c.*")
    coef = fit_grouped_logit(long, ["label"], ["eta"], "y", ridge=0.0)
    return score_grouped(long, coef, ["label"], ["eta"])


def sqrt_lasso_logit(df: DataFrame, features: list[str], y: str, lambdas: list[float] | None, target: float) -> tuple[list[str], PipelineModel, str]:
    """First penalty of a decreasing path with n * lambda / residual norm below the target, then an unpenalised logistic fit
    on its support: (support, model, rule). rule is 'target', or 'end' where no penalty met it and the last support is
    taken; an empty support then leaves all features. Rows with a NULL feature or target are not fitted."""
    stop = sqrt_lasso_stop(df, features, y, target, lambdas=lambdas)
    model = _assembled(stop.names or features, LogisticRegression(labelCol=y, regParam=0.0, maxIter=100)).fit(df.dropna(subset=[*features, y]))
    return stop.names, model, stop.rule


# --- concordance regression and importance (L15, L18) ------------------------------------------------------

def concordance_pairs(df: DataFrame, scope: str, g: str, id_col: str, n: int, seed: int, features: list[str],
                      y: str = "y") -> DataFrame:
    """Feature differences of drawn (positive, negative) pairs; half of them flipped for label balance.

    scope 'within' draws ``n`` pairs in each group, 'total' from all rows, 'between' drops the total
    draws whose rows share a group.
    """
    keys = [g] if scope == "within" else ["_all"]
    base = df if scope == "within" else df.withColumn("_all", F.lit(1))
    pairs = sample_pairs(base, keys, n, seed, id_col, y)
    x1 = df.select(F.col(id_col).alias("id1"), F.col(g).alias("_g1"), *[F.col(c).alias(f"_1_{c}") for c in features])
    x0 = df.select(F.col(id_col).alias("id0"), F.col(g).alias("_g0"), *[F.col(c).alias(f"_0_{c}") for c in features])
    d = pairs.join(x1, "id1").join(x0, "id0")
    if scope == "between":
        d = d.filter(F.col("_g1") != F.col("_g0"))
    flip = F.when(F.col("i") % 2 == 0, -1.0).otherwise(1.0)
    return d.select(*[(flip * (F.col(f"_1_{c}") - F.col(f"_0_{c}"))).alias(c) for c in features],
                    (flip > 0).cast("double").alias("y")).dropna(subset=features)


def fit_concordance(train: DataFrame, valid: DataFrame, scope: str, g: str, id_col: str, features: list[str],
                    lambdas: list[float], n: int = 2000, seed: int = 1, y: str = "y") -> tuple[list[float], list[tuple[float, float]]]:
    """Weights that maximise the sum of log sigmoid of pair differences: a logistic regression without
    intercept on feature differences, ridge chosen on validation AUROC."""
    pairs = cut_lineage(concordance_pairs(train, scope, g, id_col, n, seed, features, y))
    best, history = None, []
    for lam in lambdas:
        m = _assembled(features, LogisticRegression(labelCol="y", fitIntercept=False, regParam=lam, maxIter=50)).fit(pairs)
        w = [0.0, *m.stages[-1].coefficients.toArray().tolist()]
        v = auc(valid.withColumn("_eta", linear_score(features, w)), [], y, "_eta").first()["auc"]
        history.append((lam, v))
        if best is None or v > best[1]:
            best = (w[1:], v)
    return best[0], history


def importance(df: DataFrame, features: list[str], y: str = "y", trees: int = 20, depth: int = 4) -> DataFrame:
    """Tree importances: feature, importance."""
    model = fit_forest(df, features, y, depth, trees).stages[-1]
    rows = [(f, float(v)) for f, v in zip(features, model.featureImportances.toArray())]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double")


def null_importance(df: DataFrame, features: list[str], id_col: str, seeds: list[int], y: str = "y", trees: int = 20,
                    depth: int = 4) -> DataFrame:
    """Importances after moving the labels to other rows, one fit per seed: seed, feature, importance."""
    parts = []
    for s in seeds:
        shuffled = cut_lineage(permute(df.select(id_col, y, *features), id_col, [y], s))
        parts.append(importance(shuffled, features, y, trees, depth).withColumn("seed", F.lit(s)))
    return reduce(DataFrame.unionByName, parts)
