"""Projections, filters, recodes (section 2.B) and imputation rules that need no model.

All take and return lazy DataFrames. Functions that decide on a column list run one aggregation over
the whole table first; they say so.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from .profile import missing_profile


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def null_sentinels(df: DataFrame, codes: list[float], cols: list[str] | None = None) -> DataFrame:
    """Numeric sentinel codes to NULL, in one projection."""
    cols = set(cols or numeric_columns(df))
    return df.select(*[F.when(~F.col(c).isin(*codes), F.col(c)).alias(c) if c in cols else F.col(c)
                       for c in df.columns])


def null_strings(df: DataFrame, mode: str = "contains", cols: list[str] | None = None) -> DataFrame:
    """Lower-case text; 'contains' nulls anything holding 'null', 'equals' nulls '', 'null' and '-99'."""
    cols = set(cols or string_columns(df))

    def fix(c: str) -> Column:
        low = F.lower(F.col(c))
        bad = low.contains("null") if mode == "contains" else low.isin("", "null", "-99")
        return F.when(~bad, low).alias(c)

    return df.select(*[fix(c) if c in cols else F.col(c) for c in df.columns])


def recode(df: DataFrame, rules: dict[str, list[tuple[Column, object]]]) -> DataFrame:
    """Per column an ordered list of (condition, value); the column itself where none holds."""

    def fix(c: str) -> Column:
        out = None
        for condition, value in rules[c]:
            v = value if isinstance(value, Column) else F.lit(value)
            out = F.when(condition, v) if out is None else out.when(condition, v)
        return out.otherwise(F.col(c)).alias(c)

    return df.select(*[fix(c) if c in rules else F.col(c) for c in df.columns])


def recode_regex(df: DataFrame, rules: dict[str, list[tuple[str, str]]]) -> DataFrame:
    """Per column an ordered list of (pattern, replacement); every match is replaced."""

    def fix(c: str) -> Column:
        return reduce(lambda e, r: F.regexp_replace(e, r[0], r[1]), rules[c], F.col(c)).alias(c)

    return df.select(*[fix(c) if c in rules else F.col(c) for c in df.columns])


def map_values(df: DataFrame, col: str, mapping: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Codes to display labels by a left join; unknown codes become NULL."""
    m = mapping.select(F.col(key).alias(col), F.col(value).alias(out))
    return df.join(m, on=col, how="left")


def rarest_levels(df: DataFrame, cols: list[str]) -> DataFrame:
    """Least frequent non-null level of each column: name, level; ties: smallest value."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot([], cols, "name", "level")
    counts = long.filter(F.col("level").isNotNull()).groupBy("name", "level").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("name").agg(F.min_by("level", F.struct("n", "level")).alias("level"))


def binarise_minority(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rarest level 1, others 0, missing -1. All rarest levels (one per column) reach the rows as one scalar
    map, so the levels are counted in one pass and the plan stays lazy."""
    rare = rarest_levels(df, cols).agg(F.map_from_entries(F.collect_list(F.struct("name", "level")))).scalar()
    name = "_rare"
    while name in df.columns:
        name = "_" + name

    def fix(c: str) -> Column:
        level = F.try_element_at(F.col(name), F.lit(c))
        return F.when(F.col(c).isNull(), -1).when(F.col(c).cast("string") == level, 1).otherwise(0).alias(c)

    return df.withColumn(name, rare).select(*[fix(c) if c in cols else F.col(c) for c in df.columns])


def composite(df: DataFrame, groups: dict[str, list[str]], flag_missing: bool = False) -> DataFrame:
    """1 if any component is 1; a missing component (-1 or NULL) counts as 0."""
    out = []
    for name, cols in groups.items():
        hits = [F.coalesce((F.col(c) == 1).cast("int"), F.lit(0)) for c in cols]
        out.append((F.greatest(*hits) if len(hits) > 1 else hits[0]).alias(name))
        if flag_missing:
            miss = [F.coalesce((F.col(c) == -1).cast("int"), F.lit(1)) for c in cols]
            out.append((F.greatest(*miss) if len(miss) > 1 else miss[0]).alias(f"{name}_any_missing"))
    return df.select("*", *out)


def any_positive(df: DataFrame, prefix: str, out: str, drop: bool = True) -> DataFrame:
    """Family collapse: 1 if any column whose name starts with ``prefix`` is above 0."""
    cols = [c for c in df.columns if c.startswith(prefix)]
    total = reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0)) for c in cols])
    kept = [c for c in df.columns if not (drop and c in cols)]
    return df.select(*kept, (total > 0).cast("int").alias(out))


def to_any(df: DataFrame, cols: list[str]) -> DataFrame:
    """Counts to any (1/0); NULL counts as 0."""
    return df.select(*[F.coalesce((F.col(c) > 0).cast("int"), F.lit(0)).alias(c) if c in cols else F.col(c)
                       for c in df.columns])


def clip(c: Column, lo, hi) -> Column:
    """Value kept within [lo, hi]; NULL stays NULL."""
    return F.when(c.isNotNull(), F.greatest(F.least(c, F.lit(hi)), F.lit(lo)))


def clip_sum(df: DataFrame, cols: list[str], out: str, hi: int = 1) -> DataFrame:
    """Row sum over ``cols``, NULL as 0, cut at ``hi``."""
    total = reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0)) for c in cols])
    return df.withColumn(out, F.least(total, F.lit(hi)))


def split_version(df: DataFrame, col: str, family: str = "outcome", version: str = "version") -> DataFrame:
    """'agg_wound2' -> ('wound', 2); without a number the version is 1."""
    bare = F.regexp_replace(F.col(col), "^agg_", "")
    digits = F.regexp_replace(bare, "[^0-9]", "")
    return df.select("*", F.regexp_replace(bare, "[0-9]", "").alias(family),
                     F.coalesce(digits.try_cast("int"), F.lit(1)).alias(version))


def drop_sparse(df: DataFrame, period: str, max_periods: int = 2, missing: Column | None = None,
                cols: list[str] | None = None) -> DataFrame:
    """Drop columns that are wholly missing, or missing somewhere in more than ``max_periods`` periods.

    One aggregation job decides (one row per column and period is read by the driver).
    """
    cols = cols or [c for c in df.columns if c != period]
    decision = (missing_profile(df, period, cols).groupBy("name")
                .agg(F.sum((F.col("share") > 0).cast("int")).alias("bad"), F.min("share").alias("least")))
    gone = {r["name"] for r in decision.filter((F.col("bad") > max_periods) | (F.col("least") == 1)).collect()}
    return df.select(*[c for c in df.columns if c not in gone])


def drop_rare_labels(df: DataFrame, labels: list[str], min_events: int = 100) -> DataFrame:
    """Drop label columns with fewer events; one aggregation job decides."""
    row = df.agg(*[F.sum((F.col(c) == 1).cast("bigint")).alias(c) for c in labels]).first()
    gone = {c for c in labels if (row[c] or 0) < min_events}
    return df.select(*[c for c in df.columns if c not in gone])


def drop_constant(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Drop columns with a single value; one aggregation job decides."""
    cols = cols or df.columns
    row = df.agg(*[(F.min(c) != F.max(c)).alias(c) for c in cols]).first()
    gone = {c for c in cols if not row[c]}
    return df.select(*[c for c in df.columns if c not in gone])


def profile_buckets(profile: DataFrame, sizes: DataFrame, swing: float = 0.2, low: float = 0.4) -> DataFrame:
    """Columns by missingness: complete / absent / swing / low / high.

    profile: name, period, share; sizes: period, n.
    """
    joined = profile.join(sizes, on="period")
    agg = joined.groupBy("name").agg(
        (F.sum(F.col("share") * F.col("n")) / F.sum("n")).alias("mu"),
        (F.max("share") - F.min("share")).alias("delta"))
    return agg.select("name", "mu", "delta",
                      F.when(F.col("mu") == 0, "complete").when(F.col("mu") == 1, "absent")
                      .when(F.col("delta") > swing, "swing").when(F.col("mu") < low, "low")
                      .otherwise("high").alias("bucket"))


def code_key(c: Column) -> Column:
    """Procedure code as text key 'c<code>'."""
    return F.concat(F.lit("c"), c.cast("string"))


def code_prefix(c: Column, n: int = 3) -> Column:
    """First digits of a code."""
    return F.substring(c.cast("string"), 1, n)


def years_to_days(c: Column) -> Column:
    return F.round(c * 365.25).cast("bigint")


def cm_to_inch(c: Column) -> Column:
    return c / 2.54


def kg_to_lb(c: Column) -> Column:
    return c * 2.20462


def split_cols(df: DataFrame, col: str, pattern: str, names: list[str], limit: int = -1) -> DataFrame:
    """Split text into several columns; missing parts are NULL."""
    parts = F.split(F.col(col), pattern, limit)
    return df.select("*", *[F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(names)])


def pick(df: DataFrame, pattern: str | None = None, minus: list[str] | None = None) -> DataFrame:
    """Columns whose name matches, less some."""
    keep = [c for c in df.columns if (pattern is None or re.search(pattern, c)) and c not in (minus or [])]
    return df.select(*keep)


def override(df: DataFrame, patch: DataFrame, key: str, col: str) -> DataFrame:
    """Overwrite ``col`` at the keys of ``patch``."""
    p = patch.select(key, F.col(col).alias("_new"))
    return df.join(p, on=key, how="left").select(
        *[F.coalesce(F.col("_new"), F.col(c)).alias(c) if c == col else F.col(c) for c in df.columns])
