"""Concordance regression on pairs (L15).

Where a set of pairs is small all of them are taken, each unranked from its number; beyond, a fixed number is drawn. Either
way the pairs of one set are spread over tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.draws import draw_index
from ..session import cut_lineage
from .draws import spread_draws
from .ordered import number_rows, scan
from .ranking import auc_decompose

def class_sizes(df: DataFrame, keys: list[str], y: str) -> DataFrame:
    """keys, n1, n0: rows of either class by keys."""
    return df.groupBy(*keys).agg(F.sum((F.col(y) == 1).cast("bigint")).alias("n1"), F.sum((F.col(y) == 0).cast("bigint")).alias("n0"))


def pair_places(sizes: DataFrame, keys: list[str], most: int, seed: int, weigh: bool = False) -> DataFrame:
    """sizes' columns, i, p1, p0 (places from 1 in either class), weight: all pairs of keys with ``most`` pairs at most, ``most``
    draws with replacement of others. Keys without a class have none. ``weigh`` gives each draw its share of the pairs."""
    pairs = F.col("n1") * F.col("n0")
    few = pairs <= most
    placed = spread_draws(sizes.filter((F.col("n1") > 0) & (F.col("n0") > 0)), keys, F.least(pairs, F.lit(most)))
    k = [F.col(f"`{c}`") for c in keys]
    p1 = F.when(few, F.floor((F.col("i") - 1) / F.col("n0")).cast("bigint")).otherwise(draw_index(F.col("n1"), seed, 1, *k, F.col("i")))
    p0 = F.when(few, (F.col("i") - 1) % F.col("n0")).otherwise(draw_index(F.col("n0"), seed, 0, *k, F.col("i")))
    weight = F.when(few, 1.0).otherwise(pairs / F.lit(float(most))) if weigh else F.lit(1.0)
    return placed.withColumn("p1", p1 + 1).withColumn("p0", p0 + 1).withColumn("weight", weight)


def concordance_pairs(df: DataFrame, scope: str, g: str, id_col: str, features: list[str], y: str = "y", offset: str | None = None, most: int = 10_000,
                      seed: int = 1, weigh: bool = False) -> DataFrame:
    """x (differences of the features, positive less negative), off (of ``offset``), weight for the pairs of a scope.

    total: all positives with all negatives; within: those of each group; between: the positives of each group with the
    negatives of all other groups. Each of these sets is taken whole up to ``most`` pairs and drawn beyond. Rows with a
    NULL label, feature, offset or group take no part.
    """
    x = F.array(*[F.col(f"`{c}`").cast("double") for c in features])
    off = F.col(f"`{offset}`").cast("double") if offset else F.lit(0.0)
    rows = df.select(F.col(f"`{g}`").alias("g"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{y}`").alias("y"), x.alias("x"), off.alias("off"))
    rows = rows.filter(F.col("y").isin(0, 1) & F.col("g").isNotNull() & F.col("off").isNotNull() & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v)))
    rows = rows.withColumn("all", F.lit(0))
    key = {"total": "all", "within": "g", "between": "g"}[scope]
    sizes = class_sizes(rows, [key], "y")
    pos = number_rows(rows.filter("y = 1"), [key], ["id"], "p1").select(key, "p1", F.col("x").alias("x1"), F.col("off").alias("off1"))
    if scope == "between":
        # negatives lie group by group, so those of all other groups are two runs around the group's own
        neg = number_rows(rows.filter("y = 0"), ["all"], ["g", "id"], "p0").select("p0", F.col("x").alias("x0"), F.col("off").alias("off0"))
        runs = scan(sizes.withColumn("all", F.lit(0)), ["all"], ["g"], {"before": ("sum", "n0")}, exclusive=True, totals={"whole": "n0"})
        sizes = runs.select("g", "n1", (F.col("whole") - F.col("n0")).alias("n0"), "before", F.col("n0").alias("own"))
        at = pair_places(sizes, [key], most, seed, weigh)
        at = at.withColumn("p0", F.col("p0") + F.when(F.col("p0") > F.col("before"), F.col("own")).otherwise(F.lit(0)))
        met = at.join(pos, [key, "p1"]).join(neg, "p0")
    else:
        neg = number_rows(rows.filter("y = 0"), [key], ["id"], "p0").select(key, "p0", F.col("x").alias("x0"), F.col("off").alias("off0"))
        met = pair_places(sizes, [key], most, seed, weigh).join(pos, [key, "p1"]).join(neg, [key, "p0"])
    return met.select(F.zip_with("x1", "x0", lambda a, b: a - b).alias("x"), (F.col("off1") - F.col("off0")).alias("off"), "weight")


def fit_pairs(pairs: DataFrame, p: int, lambdas: list[float], steps: int = 40, tol: float = 1e-9) -> np.ndarray:
    """(penalties, p) weights w that minimise (sum weight * -log sigmoid(x w + off) + lambda / 2 |w|^2) / sum weight.

    Every Newton step is one pass that adds up the moments of all penalties.
    """
    pairs = cut_lineage(pairs)
    w = np.zeros((len(lambdas), p))
    live = np.ones(len(lambdas), bool)
    for _ in range(steps):
        now = w.copy()

        def partial(batches):
            hess, grad = np.zeros((len(now), p, p)), np.zeros((len(now), p))
            for pdf in batches:
                if not len(pdf):
                    continue
                x = np.array(pdf["x"].tolist(), float).reshape(len(pdf), p)
                off, weight = pdf["off"].to_numpy(float), pdf["weight"].to_numpy(float)
                for k, b in enumerate(now):
                    q = 1 / (1 + np.exp(np.clip(x @ b + off, -500, 500)))  # 1 - sigmoid
                    grad[k] += x.T @ (weight * q)
                    hess[k] += (x * (weight * q * (1 - q))[:, None]).T @ x
            for k in range(len(now)):
                yield pd.DataFrame({"k": [k], "v": [np.concatenate([hess[k].ravel(), grad[k]]).tolist()]})

        summed = pairs.mapInPandas(partial, "k int, v array<double>").groupBy("k").agg(vector_to_array(Summarizer.sum(array_to_vector("v"))).alias("v")).collect()
        if not summed:
            return w
        for r in summed:
            k, v = r["k"], np.asarray(r["v"])
            if live[k]:
                move = np.linalg.solve(v[:p * p].reshape(p, p) + (lambdas[k] + 1e-10) * np.eye(p), v[p * p:] - lambdas[k] * w[k])
                move = np.clip(move, -5, 5)
                w[k] += move
                live[k] = np.abs(move).max() >= tol
        if not live.any():
            break
    return w


def concordance_fit(train: DataFrame, valid: DataFrame, scope: str, g: str, id_col: str, features: list[str], lambdas: list[float], y: str = "y",
                    offset: str | None = None, most: int = 10_000, seed: int = 1, weigh: bool = False) -> tuple[list[float], list[tuple[float, float]]]:
    """(weights, [(penalty, validation AUROC of the scope)]): concordance regression, the penalty with the highest AUROC of its own scope.

    The offset is part of the score of total; inside a group it cancels, and between takes none, as it would tell the groups apart.
    """
    used = offset if scope == "total" else None
    pairs = concordance_pairs(train, scope, g, id_col, features, y, used, most, seed, weigh)
    w = fit_pairs(pairs, len(features), list(lambdas))
    history = []
    for lam, b in zip(lambdas, w):
        eta = F.col(f"`{used}`").cast("double") if used else F.lit(0.0)
        for c, v in zip(features, b):
            eta = eta + F.col(f"`{c}`") * float(v)
        found = {r["tt"]: r["auc"] for r in auc_decompose(valid.withColumn("_eta", eta), [], g, y, "_eta").collect()}
        history.append((float(lam), found[scope]))
    at = max(range(len(w)), key=lambda k: (-1 if history[k][1] is None else history[k][1], history[k][0]))
    return w[at].tolist(), history


def group_offset(train: DataFrame, df: DataFrame, g: str, y: str = "y", out: str = "offset", smooth: float = 1.0) -> DataFrame:
    """df with the log odds of its group under a Bernoulli naive Bayes of one-hot groups (Laplace ``smooth``); an unseen or NULL
    group has all indicators off."""
    known = train.filter(F.col(y).isin(0, 1))
    total = known.agg(F.struct(F.sum((F.col(y) == 1).cast("double")).alias("n1"), F.sum((F.col(y) == 0).cast("double")).alias("n0"))).scalar()
    counts = class_sizes(known.filter(F.col(f"`{g}`").isNotNull()).select(F.col(f"`{g}`").alias("_g"), y), ["_g"], y).withColumn("_t", total)
    p1, p0 = (F.col("n1") + smooth) / (F.col("_t.n1") + 2 * smooth), (F.col("n0") + smooth) / (F.col("_t.n0") + 2 * smooth)
    parts = cut_lineage(counts.select("_g", (F.ln(p1 / (1 - p1)) - F.ln(p0 / (1 - p0))).alias("_on"), (F.ln(1 - p1) - F.ln(1 - p0)).alias("_off"), F.ln(F.col("_t.n1") / F.col("_t.n0")).alias("_prior")))
    base = parts.agg((F.max("_prior") + F.sum("_off")).alias("b")).scalar()
    d = df.join(parts.select("_g", "_on"), F.col(f"`{g}`") == F.col("_g"), "left")
    return d.withColumn(out, F.coalesce("_on", F.lit(0.0)) + base).select(*[c for c in df.columns if c != out], out)
