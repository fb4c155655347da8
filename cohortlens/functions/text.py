"""Small scalar functions as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F


def levenshtein_ratio(a: Column, b: Column) -> Column:
    """1 - edit distance over the longer length."""
    longest = F.nullif(F.greatest(F.length(a), F.length(b)).cast("double"), F.lit(0.0))
    return 1 - F.levenshtein(a, b) / longest


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def log_odds(p: Column) -> Column:
    """ln(p / (1 - p)); NULL outside (0, 1)."""
    return F.when((p > 0) & (p < 1), F.ln(p / (1 - p)))


def softmax(scores: list[Column]) -> list[Column]:
    """Normalised exponentials, shifted by the largest score."""
    top = F.greatest(*scores) if len(scores) > 1 else scores[0]
    parts = [F.exp(s - top) for s in scores]
    total = reduce(lambda a, b: a + b, parts)
    return [p / total for p in parts]
