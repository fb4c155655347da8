"""One logistic model per group on mixed columns (L5, L6, L14): hundreds of one-hot columns, any number and size of groups.

Rows are cut into blocks of (keys, block) of bounded size and shuffled once. A group of one block is fitted where it lies, to
convergence. Blocks of larger groups are packed to one row each and written; every Newton step joins the packed blocks with
the coefficients of the groups that have not converged, adds up moments block by block, and solves one small system per group.
Both ways take the same steps, so a model does not depend on the block size; a group with a third of all rows is many tasks'
work, and finished groups leave the loop.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage, cut_spread
from .features import expanding_folds
from .paths import Design, design_of
from .ranking import auc

#: Rows of a block.
BLOCK_ROWS = 8192
STEPS, TOLERANCE = 50, 1e-8


def _dense(design: Design, x: np.ndarray, codes: np.ndarray, mean: np.ndarray, sd: np.ndarray) -> np.ndarray:
    return design.matrix((x - mean) / np.where(sd > 0, sd, 1.0), codes)


def _moments(z: np.ndarray, y: np.ndarray, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(Hessian, gradient, log likelihood) of these rows."""
    eta = np.clip(z @ beta, -500, 500)
    mu = 1 / (1 + np.exp(-eta))
    return (z * (mu * (1 - mu))[:, None]).T @ z, z.T @ (y - mu), float(y @ eta - np.logaddexp(0, eta).sum())


def _step(hess: np.ndarray, grad: np.ndarray, beta: np.ndarray, ridge: float) -> np.ndarray:
    """Change of beta: a Newton step, each coefficient by 5 at most. The intercept is not penalised; a tiny penalty keeps separated
    groups and empty columns solvable."""
    pen = np.full(len(beta), ridge)
    pen[0] = 0.0
    return np.clip(np.linalg.solve(hess + np.diag(pen + 1e-8), grad - pen * beta), -5, 5)


def _start(n1: float, n0: float, p: int) -> np.ndarray:
    beta = np.zeros(p)
    beta[0] = np.log(n1 / n0)
    return beta


def _errors(hess: np.ndarray) -> list[float]:
    return np.sqrt(np.maximum(np.diag(np.linalg.pinv(hess)), 0)).tolist()


def _arrays(pdf: pd.DataFrame, design: Design) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = np.array(pdf["_x"].tolist(), float).reshape(len(pdf), len(design.nums))
    codes = np.array([[-1 if v is None or v != v else v for v in c] for c in pdf["_c"]], np.int32).reshape(len(pdf), len(design.levels))
    return x, codes, pdf["_y"].to_numpy(float)


def fit_grouped(df: DataFrame, keys: list[str], design: Design, y: str = "y", ridge: float = 1.0, steps: int = STEPS, tol: float = TOLERANCE) -> DataFrame:
    """keys, n1, n0, mean, sd, beta (intercept first, then design.names), se, steps, converged: one row for each group with both
    classes among its complete rows (0/1 label, no NULL number). Runs jobs.

    Numbers are scaled by the group's own mean and sd (over n; a constant one is 0); se is that of the scaled columns, of the
    unpenalised information. A model has converged when no coefficient of a step moves by ``tol``; others stop after ``steps``.
    """
    p = 1 + len(design.names)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in keys)
    order = [f.name for f in df.schema.fields if f.name in keys]
    rows = df.select(*order, F.col(y).cast("double").alias("_y"), design.values().alias("_x"), design.codes().alias("_c"))
    rows = rows.filter(F.col("_y").isin(0.0, 1.0) & F.forall("_x", lambda v: v.isNotNull() & ~F.isnan(v)))
    for k in order:
        rows = rows.filter(F.col(f"`{k}`").isNotNull())
    rows = cut_spread(rows).withColumn("_n", F.monotonically_increasing_id())
    # moments of the numbers, around each group's mean: two passes over few columns
    nums = range(len(design.nums))
    size = rows.groupBy(*order).agg(F.sum("_y").cast("bigint").alias("n1"), F.sum(1 - F.col("_y")).cast("bigint").alias("n0"),
                                    F.array(*[F.avg(F.col("_x")[i]) for i in nums]).cast("array<double>").alias("mean"),
                                    F.array(*[F.stddev_pop(F.col("_x")[i]) for i in nums]).cast("array<double>").alias("sd"))
    size = cut_lineage(size.filter((F.col("n1") > 0) & (F.col("n0") > 0)).withColumn("_blocks", F.ceil((F.col("n1") + F.col("n0")) / BLOCK_ROWS).cast("int")))
    blocked = rows.join(size.select(*order, "n1", "n0", "mean", "sd", "_blocks"), order).withColumn("_block", F.pmod(F.xxhash64("_n"), F.col("_blocks")).cast("int"))

    model = f"{kinds}, n1 bigint, n0 bigint, mean array<double>, sd array<double>, beta array<double>, se array<double>, steps int, converged boolean"

    def alone(pdf: pd.DataFrame) -> pd.DataFrame:
        one = pdf.iloc[0]
        x, codes, t = _arrays(pdf, design)
        z = _dense(design, x, codes, np.asarray(one["mean"], float), np.asarray(one["sd"], float))
        beta, done, k = _start(one["n1"], one["n0"], p), False, 0
        while k < steps and not done:
            hess, grad, _ = _moments(z, t, beta)
            move = _step(hess, grad, beta, ridge)
            beta, k = beta + move, k + 1
            done = bool(np.abs(move).max() < tol)
        return pd.DataFrame([[*(one[c] for c in order), one["n1"], one["n0"], one["mean"], one["sd"], beta.tolist(), _errors(_moments(z, t, beta)[0]), k, done]],
                            columns=[*order, "n1", "n0", "mean", "sd", "beta", "se", "steps", "converged"])

    small = cut_lineage(blocked.filter("_blocks = 1").groupBy(*order).applyInPandas(alone, model))
    large = size.filter("_blocks > 1")
    if large.isEmpty():
        return small

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        x, codes, t = _arrays(pdf, design)
        return pd.DataFrame([[*(pdf[c].iloc[0] for c in order), x.tobytes(), codes.tobytes(), t.astype(np.int8).tobytes()]], columns=[*order, "_x", "_c", "_y"])

    blocks = cut_lineage(blocked.filter("_blocks > 1").groupBy(*order, "_block").applyInPandas(packed, f"{kinds}, _x binary, _c binary, _y binary"))
    upper = np.triu_indices(p)

    def summed(batches):
        for pdf in batches:
            for row in pdf.to_dict("records"):
                t = np.frombuffer(row["_y"], np.int8).astype(float)
                x, codes = np.frombuffer(row["_x"]).reshape(len(t), len(design.nums)), np.frombuffer(row["_c"], np.int32).reshape(len(t), len(design.levels))
                z = _dense(design, x, codes, np.asarray(row["mean"], float), np.asarray(row["sd"], float))
                hess, grad, _ = _moments(z, t, np.asarray(row["beta"], float))
                yield pd.DataFrame([[*(row[c] for c in order), np.concatenate([hess[upper], grad]).tolist()]], columns=[*order, "v"])

    def moments(coef: DataFrame) -> DataFrame:
        made = blocks.join(coef.select(*order, "mean", "sd", "beta"), order).mapInPandas(summed, f"{kinds}, v array<double>")
        return made.groupBy(*order).agg(vector_to_array(Summarizer.sum(array_to_vector("v"))).alias("v"))

    def unpacked(v) -> tuple[np.ndarray, np.ndarray]:
        v = np.asarray(v, float)
        full = np.zeros((p, p))
        full[upper] = v[:len(upper[0])]
        return full + np.triu(full, 1).T, v[len(upper[0]):]

    def moved(batches):
        for pdf in batches:
            out = []
            for v, beta in zip(pdf["v"], pdf["beta"]):
                hess, grad = unpacked(v)
                step = _step(hess, grad, np.asarray(beta, float), ridge)
                out.append(((np.asarray(beta, float) + step).tolist(), bool(np.abs(step).max() < tol)))
            yield pdf.drop(columns=["v", "beta"]).assign(beta=[b for b, _ in out], converged=[c for _, c in out], steps=pdf["steps"] + 1)[[*order, "n1", "n0", "mean", "sd", "beta", "steps", "converged"]]

    state = f"{kinds}, n1 bigint, n0 bigint, mean array<double>, sd array<double>, beta array<double>, steps int, converged boolean"
    coef = cut_lineage(large.select(*order, "n1", "n0", "mean", "sd", F.concat(F.array(F.ln(F.col("n1") / F.col("n0"))), F.array_repeat(F.lit(0.0), p - 1)).alias("beta"),
                                    F.lit(0).alias("steps"), F.lit(False).alias("converged")))
    done = coef.limit(0)
    for _ in range(steps):
        nxt = coef.join(moments(coef), order).select(*order, "n1", "n0", "mean", "sd", "beta", "steps", "v")
        coef = cut_lineage(nxt.mapInPandas(moved, state))
        done = done.unionByName(coef.filter("converged"))
        coef = coef.filter("not converged")
        if coef.isEmpty():
            break
    ended = cut_lineage(done.unionByName(coef))

    @F.pandas_udf("array<double>")
    def errors(v: pd.Series) -> pd.Series:
        return pd.Series([_errors(unpacked(x)[0]) for x in v])

    last = ended.join(moments(ended), order).withColumn("se", errors("v"))
    names = [*order, "n1", "n0", "mean", "sd", "beta", "se", "steps", "converged"]
    return small.select(*names).unionByName(last.select(*names))


def score_groups(df: DataFrame, coef: DataFrame, keys: list[str], design: Design, out: str = "preds") -> DataFrame:
    """Rows of groups that have a model, with its probability (arithmetic on columns); NULL beside a NULL number, unseen levels
    count as none."""
    own = "_model"
    while own in df.columns:
        own = "_" + own
    eta = F.col(own)["beta"][0]
    for i, c in enumerate(design.nums):
        sd = F.col(own)["sd"][i]
        eta = eta + F.col(own)["beta"][i + 1] * (F.col(f"`{c}`").cast("double") - F.col(own)["mean"][i]) / F.when(sd > 0, sd).otherwise(1.0)
    for c in design.levels:
        eta = eta + F.coalesce(F.get(F.col(own)["beta"], design.code(c)), F.lit(0.0))
    d = df.join(coef.select(*keys, F.struct("mean", "sd", "beta").alias(own)), keys)
    return d.withColumn(out, 1 / (1 + F.exp(-eta))).drop(own)


def fit_sub_models(df: DataFrame, period: str, g: list[str], nums: list[str], cats: list[str], y: str = "y", ridges: tuple[float, ...] = (1.0,),
                   steps: int = STEPS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sub-models over expanding periods: (test scores, validation, models).

    For every group, test period and ridge: a model on the periods before the validation period, its AUROC there
    (validation: fold, g, ridge, n1, n0, auc, steps, converged; the table from which best_params chooses), and a model on all
    periods before the test period (models: fold, g, ridge, ...; fold NULL: on all usable periods). Test scores: the rows of
    the test period with ridge and preds. A group without both classes in a part gets no model there.
    """
    design = design_of(df, nums, cats)
    folds = cut_lineage(expanding_folds(df, period, y))
    # all usable periods: every test period, and the first one, which only trains
    first = folds.filter("role = 'train'").join(folds.agg(F.min("fold").alias("fold")), "fold")
    final = folds.filter("role = 'test'").unionByName(first.select(*folds.columns))
    tests, valids, models = [], [], []
    for ridge in ridges:  # a handful
        tag = F.lit(float(ridge)).alias("ridge")
        early = fit_grouped(folds.filter("role = 'train'"), ["fold", *g], design, y, ridge, steps)
        v = score_groups(folds.filter("role = 'valid'"), early, ["fold", *g], design)
        checked = auc(v, ["fold", *g], y, "preds").select("fold", *g, "n1", "n0", "auc").join(early.select("fold", *g, "steps", "converged"), ["fold", *g])
        valids.append(checked.withColumn("ridge", F.lit(float(ridge))))
        late = fit_grouped(folds.filter("role <> 'test'"), ["fold", *g], design, y, ridge, steps)
        tests.append(score_groups(folds.filter("role = 'test'"), late, ["fold", *g], design).drop("role").select("*", tag))
        whole_fit = fit_grouped(final.withColumn("_all", F.lit(1)), ["_all", *g], design, y, ridge, steps)
        everything = whole_fit.drop("_all").withColumn("fold", F.lit(None).cast(folds.schema["fold"].dataType))
        models.append(late.unionByName(everything).select("*", tag))

    def stacked(parts):
        out = parts[0]
        for x in parts[1:]:
            out = out.unionByName(x)
        return out

    return stacked(tests), stacked(valids), stacked(models)
