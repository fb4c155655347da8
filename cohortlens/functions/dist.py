"""Distribution functions Spark lacks.

The normal ones are column expressions. Chi-square, F and beta are vectorised pandas UDFs meant for
small result tables (one row per test).
"""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType

# Abramowitz and Stegun, formula 26.2.17.
CDF_SCALE = 0.2316419
CDF_COEFFICIENTS = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
SQRT_2PI = 2.5066282746310002

# Acklam's rational approximation of the normal quantile.
PPF_A = (-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02,
         1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00)
PPF_B = (-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02,
         6.680131188771972e+01, -1.328068155288572e+01)
PPF_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00,
         -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00)
PPF_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00, 3.754408661907416e+00)
PPF_LOW = 0.02425


def normal_quantile(p: float) -> float:
    """Normal quantile of a constant."""
    return NormalDist().inv_cdf(p)


def norm_cdf(x: Column) -> Column:
    """Normal CDF; absolute error below 7.5e-8."""
    t = 1.0 / (1.0 + CDF_SCALE * F.abs(x))
    poly = F.lit(0.0)
    for c in reversed(CDF_COEFFICIENTS):
        poly = (poly + c) * t
    tail = F.exp(-x * x / 2.0) / SQRT_2PI * poly
    return F.when(x >= 0, 1.0 - tail).otherwise(tail)


def _horner(coefficients, x: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def norm_ppf(p: Column) -> Column:
    """Normal quantile of a column; NULL outside (0, 1); relative error below 1.2e-9."""
    tail_p = F.least(p, 1.0 - p)
    q = F.sqrt(-2.0 * F.ln(tail_p))
    tail = _horner(PPF_C, q) / (_horner(PPF_D, q) * q + 1.0)
    d = p - 0.5
    r = d * d
    middle = _horner(PPF_A, r) * d / (_horner(PPF_B, r) * r + 1.0)
    return (F.when((p <= 0) | (p >= 1), None)
            .when(p < PPF_LOW, tail).when(p > 1 - PPF_LOW, -tail).otherwise(middle))


def _log_gamma(x):
    # Lanczos, g = 7; fixed values.
    coefficients = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313,
                    -176.61502916214059, 12.507343278686905, -0.13857109526572012,
                    9.9843695780195716e-6, 1.5056327351493116e-7)
    x = np.asarray(x, float) - 1
    total = np.full_like(x, coefficients[0])
    for i, c in enumerate(coefficients[1:], 1):
        total = total + c / (x + i)
    t = x + 7.5
    return 0.5 * np.log(2 * np.pi) + (x + 0.5) * np.log(t) - t + np.log(total)


def reg_gamma_upper(a, x):
    """Regularised upper incomplete gamma Q(a, x)."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    x = np.maximum(x, 0.0)
    safe = np.where(x > 0, x, 1.0)
    front = np.exp(a * np.log(safe) - safe - _log_gamma(a))
    term = 1.0 / a
    series = term.copy()
    for n in range(1, 600):
        term = term * safe / (a + n)
        series += term
    lower = front * series
    tiny = 1e-300
    b = safe + 1 - a
    c = np.full_like(b, 1 / tiny)
    d = 1 / np.where(b == 0, tiny, b)
    h = d.copy()
    for i in range(1, 600):
        an = -i * (i - a)
        b = b + 2
        d = an * d + b
        d = 1 / np.where(np.abs(d) < tiny, tiny, d)
        c = b + an / c
        c = np.where(np.abs(c) < tiny, tiny, c)
        h = h * d * c
    q = np.where(safe < a + 1, 1 - lower, front * h)
    return np.where(x > 0, np.clip(q, 0, 1), 1.0)


def reg_beta(a, b, x):
    """Regularised incomplete beta I_x(a, b)."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.asarray(x, float))
    inner = np.clip(x, 1e-300, 1 - 1e-16)
    swap = inner > (a + 1) / (a + b + 2)
    aa, bb, xx = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - inner, inner)
    front = np.exp(_log_gamma(aa + bb) - _log_gamma(aa) - _log_gamma(bb)
                   + aa * np.log(xx) + bb * np.log1p(-xx)) / aa
    tiny = 1e-300
    c = np.ones_like(xx)
    d = 1 - (aa + bb) * xx / (aa + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 300):
        for num in (m * (bb - m) * xx / ((aa + 2 * m - 1) * (aa + 2 * m)),
                    -(aa + m) * (aa + bb + m) * xx / ((aa + 2 * m) * (aa + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
    value = front * h
    out = np.where(swap, 1 - value, value)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, out))


@F.pandas_udf(DoubleType())
def chi2_sf(x: pd.Series, dof: pd.Series) -> pd.Series:
    """Upper tail of the chi-square distribution."""
    return pd.Series(reg_gamma_upper(dof.to_numpy(float) / 2, x.to_numpy(float) / 2))


@F.pandas_udf(DoubleType())
def f_sf(x: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    """Upper tail of the F distribution."""
    x, d1, d2 = (s.to_numpy(float) for s in (x, d1, d2))
    return pd.Series(reg_beta(d2 / 2, d1 / 2, d2 / (d2 + d1 * x)))


def _beta_quantile(q, a, b):
    lo, hi = np.zeros_like(a), np.ones_like(a)
    for _ in range(60):
        mid = (lo + hi) / 2
        below = reg_beta(a, b, mid) < q
        lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
    return (lo + hi) / 2


@F.pandas_udf(DoubleType())
def beta_ppf(q: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    """Beta quantile by bisection."""
    return pd.Series(_beta_quantile(*(s.to_numpy(float) for s in (q, a, b))))
