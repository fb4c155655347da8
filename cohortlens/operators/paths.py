"""Lasso paths on moments (L13, L17).

One pass over the rows sums X'X, X'y and y'y for each fold: a task adds up its own rows block by block, and what is shuffled
is one matrix row for each task, fold and feature. A fold's training moments are the total less its own, its validation
error is a quadratic form in its own, so every penalty of every fold is solved on p by p matrices without touching rows
again. Coordinate descent runs down the penalties with warm starts.

The number of design columns is bounded (MOST_COLUMNS), as p by p matrices of all folds are read by the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

#: Design columns beyond which moments are refused, and levels of one categorical column.
MOST_COLUMNS = 2000
#: Rows whose dense design is held at once.
BLOCK = 4096


# --- the design -----------------------------------------------------------------------------------

@dataclass(frozen=True)
class Design:
    """Numeric columns and 0/1 columns of the levels of categorical ones, by position (0 is the intercept)."""

    nums: tuple[str, ...]
    levels: dict[str, tuple[str, ...]] = field(default_factory=dict)

    @property
    def names(self) -> list[str]:
        return [*self.nums, *(f"{c}={v}" for c, vs in self.levels.items() for v in vs)]

    def first(self, col: str) -> int:
        """Position of the first level of ``col``."""
        at = 1 + len(self.nums)
        for c, vs in self.levels.items():
            if c == col:
                return at
            at += len(vs)
        raise KeyError(col)

    def code(self, col: str) -> Column:
        """Position of a row's level; NULL for a NULL or unseen one, whose columns are all zero."""
        vs = self.levels[col]
        if not vs:
            return F.lit(None).cast("int")
        table = F.create_map(*[x for i, v in enumerate(vs) for x in (F.lit(v), F.lit(self.first(col) + i))])
        return F.try_element_at(table, F.col(f"`{col}`").cast("string"))

    def codes(self) -> Column:
        return F.array(*[self.code(c) for c in self.levels]).cast("array<int>")

    def values(self) -> Column:
        return F.array(*[F.col(f"`{c}`").cast("double") for c in self.nums]).cast("array<double>")

    def score(self, beta: np.ndarray) -> Column:
        """beta[0] + x'beta as an expression; NULL beside a NULL number."""
        eta = reduce(lambda a, b: a + b, [F.col(f"`{c}`").cast("double") * float(w) for c, w in zip(self.nums, beta[1:])], F.lit(float(beta[0])))
        for c, vs in self.levels.items():
            a = self.first(c)
            on = [(v, float(w)) for v, w in zip(vs, beta[a:a + len(vs)]) if w]
            if on:
                table = F.create_map(*[x for v, w in on for x in (F.lit(v), F.lit(w))])
                eta = eta + F.coalesce(F.try_element_at(table, F.col(f"`{c}`").cast("string")), F.lit(0.0))
        return eta

    def matrix(self, nums: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """(rows, 1 + columns) from numbers and codes (-1: no level)."""
        x = np.zeros((len(nums), 1 + len(self.names)))
        x[:, 0] = 1
        x[:, 1:1 + len(self.nums)] = nums
        row, at = np.nonzero(codes >= 0)
        x[row, codes[row, at]] = 1
        return x


def learn_levels(train: DataFrame, cats: list[str], most: int = MOST_COLUMNS) -> dict[str, tuple[str, ...]]:
    """Levels of each column in order. The counts are taken first: more than ``most`` are refused, not read."""
    if not cats:
        return {}
    long = train.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in cats]).unpivot([], [f"`{c}`" for c in cats], "name", "level").filter("level is not null")
    found = long.groupBy("name", "level").count()
    sizes = {r["name"]: r["count"] for r in found.groupBy("name").count().collect()}
    wide = {c: n for c, n in sizes.items() if n > most}
    if wide:
        raise ValueError(f"more than {most} levels: {wide}")
    rows = found.select("name", "level").orderBy("name", "level").collect()
    return {c: tuple(r["level"] for r in rows if r["name"] == c) for c in cats}


def design_of(train: DataFrame, nums: list[str], cats: list[str] = ()) -> Design:
    design = Design(tuple(nums), learn_levels(train, list(cats)))
    if len(design.names) > MOST_COLUMNS:
        raise ValueError(f"{len(design.names)} design columns; {MOST_COLUMNS} at most")
    return design


def batches_of(pdf: pd.DataFrame, design: Design):
    """Row ranges of a batch with columns _x and _c, with their dense design."""
    for a in range(0, len(pdf), BLOCK):
        part = pdf.iloc[a:a + BLOCK]
        nums = np.array(part["_x"].tolist(), float).reshape(len(part), len(design.nums))
        codes = np.array([[-1 if v is None or v != v else v for v in c] for c in part["_c"]], np.int64).reshape(len(part), len(design.levels))
        yield part, design.matrix(nums, codes)


# --- moments --------------------------------------------------------------------------------------

@dataclass
class Moments:
    """Sums of x x', x y, y y and rows; x starts with the intercept's 1."""

    xx: np.ndarray
    xy: np.ndarray
    yy: float
    n: float

    def __add__(self, other: "Moments") -> "Moments":
        return Moments(self.xx + other.xx, self.xy + other.xy, self.yy + other.yy, self.n + other.n)

    def __sub__(self, other: "Moments") -> "Moments":
        return Moments(self.xx - other.xx, self.xy - other.xy, self.yy - other.yy, self.n - other.n)

    def error(self, beta: np.ndarray) -> float:
        """Sum of squared residuals of these rows under ``beta``."""
        return float(self.yy - 2 * beta @ self.xy + beta @ self.xx @ beta)


def fold_moments(df: DataFrame, design: Design, y: str, fold: str) -> dict[int, Moments]:
    """Moments by fold from one pass. Rows with a NULL target, fold or number are left out."""
    p = 1 + len(design.names)
    rows = df.select(F.col(f"`{fold}`").cast("int").alias("_f"), F.col(f"`{y}`").cast("double").alias("_y"), design.values().alias("_x"), design.codes().alias("_c"))
    rows = rows.filter(F.col("_f").isNotNull() & F.col("_y").isNotNull() & ~F.isnan("_y") & F.forall("_x", lambda v: v.isNotNull() & ~F.isnan(v)))

    def partial(batches):
        sums: dict[int, np.ndarray] = {}
        for pdf in batches:
            for part, x in batches_of(pdf, design):
                full = np.column_stack([x, part["_y"].to_numpy(float)])
                folds = part["_f"].to_numpy()
                for f in np.unique(folds):
                    z = full[folds == f]
                    sums[int(f)] = sums.get(int(f), 0) + z.T @ z
        for f, m in sums.items():
            yield pd.DataFrame({"f": f, "i": np.arange(p + 1), "v": list(m)})

    made = rows.mapInPandas(partial, "f int, i int, v array<double>")
    summed = made.groupBy("f", "i").agg(vector_to_array(Summarizer.sum(array_to_vector("v"))).alias("v")).collect()
    out: dict[int, np.ndarray] = {}
    for r in summed:
        out.setdefault(r["f"], np.zeros((p + 1, p + 1)))[r["i"]] = r["v"]
    return {f: Moments(m[:p, :p], m[:p, p], float(m[p, p]), float(m[0, 0])) for f, m in sorted(out.items())}


# --- the path -------------------------------------------------------------------------------------

def penalties(m: Moments, count: int = 100, ratio: float = 0.001) -> np.ndarray:
    """Penalties from the least that empties the support, down to ``ratio`` of it, in equal steps of the logarithm."""
    _, c, _ = _scaled(m)
    top = float(np.abs(c).max(initial=0))
    return np.exp(np.linspace(np.log(top), np.log(top * ratio), count)) if top > 0 else np.zeros(0)


def _scaled(m: Moments) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(correlations, covariances with y over sd, sd) of the columns; a constant column has sd 0 and zeros."""
    mean = m.xx[0, 1:] / m.n
    cov = m.xx[1:, 1:] / m.n - np.outer(mean, mean)
    var = np.diag(cov)
    sd = np.where(var > 1e-12 * np.maximum(np.diag(m.xx)[1:] / m.n, 1e-300), np.sqrt(np.maximum(var, 0)), 0.0)
    safe = np.where(sd > 0, sd, 1.0)
    on = (sd > 0).astype(float)
    return cov / np.outer(safe, safe) * np.outer(on, on), (m.xy[1:] / m.n - mean * m.xy[0] / m.n) / safe * on, sd


def descend(m: Moments, lambdas: np.ndarray, mix: float = 1.0, tol: float = 1e-10, sweeps: int = 10_000) -> np.ndarray:
    """(penalties, 1 + columns): coefficients of the elastic net (mix 1: lasso) on columns scaled to standard deviation 1 (over n), given back
    on the original scale, for each penalty of a decreasing path. The intercept is not penalised."""
    q, c, sd = _scaled(m)
    p = len(c)
    b, grad = np.zeros(p), c.copy()  # grad = c - q b
    diag = np.diag(q).copy()
    live = np.flatnonzero(sd > 0)
    out = np.zeros((len(lambdas), p + 1))

    def sweep(at: np.ndarray, lam: float) -> float:
        nonlocal grad
        most = 0.0
        for j in at:
            z = grad[j] + diag[j] * b[j]
            new = np.sign(z) * max(abs(z) - lam * mix, 0.0) / (diag[j] + lam * (1 - mix))
            step = new - b[j]
            if step:
                b[j] = new
                grad -= q[:, j] * step
                most = max(most, abs(step))
        return most

    limit = tol * max(float(np.abs(c).max(initial=0)), 1e-300)
    for k, lam in enumerate(lambdas):
        for _ in range(sweeps):
            if sweep(live, lam) <= limit:
                break
            for _ in range(sweeps):  # settle the support before all columns are tried again
                if sweep(np.flatnonzero(b), lam) <= limit:
                    break
        safe = np.where(sd > 0, sd, 1.0)
        out[k, 1:] = b / safe
        out[k, 0] = (m.xy[0] - out[k, 1:] @ m.xx[0, 1:]) / m.n
    return out


@dataclass
class Path:
    """A cross-validated path: penalties from the largest, coefficients on all rows, mean squared error over folds with its
    standard error, and the places of the least error and of the largest penalty within one standard error of it."""

    design: Design
    lambdas: np.ndarray
    coefs: np.ndarray
    error: np.ndarray
    se: np.ndarray
    best: int
    chosen: int
    total: Moments

    def predict(self, df: DataFrame, out: str = "prediction", rule: str = "1se") -> DataFrame:
        """df with the fitted value; NULL beside a NULL number, unseen levels count as none."""
        return df.withColumn(out, self.design.score(self.coefs[self.chosen if rule == "1se" else self.best]))

    def r_squared(self, rule: str = "1se") -> float:
        """1 - cross-validated squared error over the variance of the target."""
        at = self.chosen if rule == "1se" else self.best
        spread = self.total.yy / self.total.n - (self.total.xy[0] / self.total.n) ** 2
        return float(1 - self.error[at] / spread) if spread > 0 else float("nan")


def lasso_cv(df: DataFrame, nums: list[str], y: str, fold: str, cats: list[str] = (), lambdas: list[float] | None = None, count: int = 100,
             ratio: float = 0.001, mix: float = 1.0) -> Path:
    """Lasso (elastic net) path with cross-validation over given folds: one job, whatever the number of penalties and folds.

    ``lambdas`` defaults to ``count`` penalties from the smallest that empties the support on all rows. Errors are averaged
    over folds with equal weight, as are their deviations. A single fold gives no error: the smallest penalty is taken.
    """
    design = design_of(df, nums, cats)
    parts = fold_moments(df, design, y, fold)
    if not parts:
        raise ValueError("no complete rows")
    total = reduce(lambda a, b: a + b, parts.values())
    grid = np.sort(np.asarray(lambdas, float))[::-1] if lambdas is not None else penalties(total, count, ratio)
    if not len(grid):
        grid = np.zeros(1)
    coefs = descend(total, grid, mix)
    errors = []
    if len(parts) > 1:
        for held in parts.values():
            errors.append([held.error(b) / held.n for b in descend(total - held, grid, mix)])
    if not errors:
        none = np.full(len(grid), np.nan)
        return Path(design, grid, coefs, none, none, len(grid) - 1, len(grid) - 1, total)
    e = np.array(errors)
    mean, se = e.mean(axis=0), e.std(axis=0, ddof=1) / np.sqrt(len(e))
    best = int(mean.argmin())
    return Path(design, grid, coefs, mean, se, best, int(np.flatnonzero(mean <= mean[best] + se[best])[0]), total)


@dataclass
class Stopped:
    """Where a path met n * penalty / residual norm < target: support (positions in design.names), the penalties tried with
    that statistic, and ``rule``: 'target', or 'end' where no penalty met it and the support is the last one's."""

    design: Design
    support: list[int]
    lambdas: np.ndarray
    statistic: np.ndarray
    rule: str

    @property
    def names(self) -> list[str]:
        return [self.design.names[i] for i in self.support]


def sqrt_lasso_stop(df: DataFrame, nums: list[str], y: str, target: float, cats: list[str] = (), lambdas: list[float] | None = None,
                    count: int = 100, ratio: float = 0.001) -> Stopped:
    """Square-root-lasso stopping rule on a lasso path: the first penalty, from the largest down, where the statistic is
    below ``target`` and the support is not empty. One pass over the rows."""
    design = design_of(df, nums, cats)
    parts = fold_moments(df.withColumn("_one", F.lit(0)), design, y, "_one")
    if not parts:
        raise ValueError("no complete rows")
    m = parts[0]
    grid = np.sort(np.asarray(lambdas, float))[::-1] if lambdas is not None else penalties(m, count, ratio)
    coefs = descend(m, grid)
    norms = np.sqrt(np.maximum([m.error(b) for b in coefs], 0)) if len(grid) else np.zeros(0)
    stat = np.where(norms > 0, m.n * grid / np.where(norms > 0, norms, 1), np.inf)
    met = [k for k in range(len(grid)) if stat[k] < target and np.any(coefs[k, 1:])]
    at = met[0] if met else len(grid) - 1
    support = np.flatnonzero(coefs[at, 1:]).tolist() if len(grid) else []
    return Stopped(design, support, grid[:at + 1], stat[:at + 1], "target" if met else "end")


def ridge_tune(df: DataFrame, nums: list[str], y: str, part: str, cats: list[str] = (), count: int = 100, least: float = 0.01) -> tuple[Design, np.ndarray, list[tuple[float, float]]]:
    """Ridge from accumulated moments (L11): (design, coefficients, [(penalty, validation R-squared)]).

    ``part`` is 0 on training and 1 on validation rows; one pass sums both. Each column's penalty is scaled by its variance,
    the intercept has none. From no penalty upwards, ``count`` equal steps of the logarithm from ``least`` to ten times the
    largest |X'y| / n, until R-squared falls; the last better one is taken.
    """
    design = design_of(df.filter(F.col(f"`{part}`") == 0), nums, cats)
    parts = fold_moments(df, design, y, part)
    if 0 not in parts or 1 not in parts:
        raise ValueError("no complete rows in a part")
    m, v = parts[0], parts[1]
    mean = m.xx[0] / m.n
    scale = np.diag(m.xx) / m.n - mean * mean
    spread = v.yy - v.xy[0] ** 2 / v.n
    history, best = [], None
    for lam in [0.0, *np.exp(np.linspace(np.log(least), np.log(np.abs(m.xy / m.n).max() / 0.1), count))]:
        lhs = m.xx / m.n + lam * np.diag(scale)
        beta = np.linalg.lstsq(lhs, m.xy / m.n, rcond=None)[0] if np.linalg.matrix_rank(lhs) < len(lhs) else np.linalg.solve(lhs, m.xy / m.n)
        r2 = float(1 - v.error(beta) / spread) if spread > 0 else float("nan")
        history.append((float(lam), r2))
        if len(history) > 1 and r2 < history[-2][1]:
            break
        best = beta
    return design, best, history
