"""Stateless pseudo-random numbers: the same in any engine, partitioning or retry.

A draw is a function of (seed, labels), taken from the first 13 hex digits (52 bits) of an md5, so a
lost executor recomputes the very same sample.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

HEX_DIGITS = 13
SPAN = 16**HEX_DIGITS


def _text(part) -> Column:
    return (part if isinstance(part, Column) else F.lit(part)).cast("string")


def draw_bits(*parts) -> Column:
    """Integer in [0, 16^13) from the parts (columns or literals; integers and strings only)."""
    digest = F.md5(F.concat_ws(":", *[_text(p) for p in parts]))
    return F.conv(F.substring(digest, 1, HEX_DIGITS), 16, 10).cast("bigint")


def draw_index(n: Column, *parts) -> Column:
    """Integer in [0, n)."""
    return draw_bits(*parts) % n


def draw_uniform(*parts) -> Column:
    """Double in [0, 1)."""
    return draw_bits(*parts) / F.lit(float(SPAN))
