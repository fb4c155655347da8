"""Feature engineering and splits (section 2.K)."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer
from pyspark.ml.param.shared import HasInputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.draws import draw_bits, draw_index, draw_uniform
from .draws import spread_draws
from .ordered import number_rows, quantile_columns
from .ranking import div
from .resample import numbered


def column_kinds(df: DataFrame, cols: list[str]) -> DataFrame:
    """name, kind: num, str, or lst (text holding '|' somewhere). One aggregation for the text columns."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    text = [c for c in cols if isinstance(kinds[c], T.StringType)]
    cells = [F.struct(F.lit(c).alias("name"),
                      (F.when(F.coalesce(F.max(F.col(c).contains("|")), F.lit(False)), "lst").otherwise("str")
                       if c in text else F.lit("num")).alias("kind")) for c in cols]
    return df.agg(F.array(*cells).alias("_c")).select(F.explode("_c").alias("_c")).select("_c.*")


class ModeDropEncoder(Estimator, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """One-hot without the most frequent level (columns <col>_vec); levels unseen in training count as the most frequent.

    A pipeline stage; what fit() returns is made of stages that Spark reads and writes.
    """

    def __init__(self, cols: list[str] | None = None):
        super().__init__()
        if cols is not None:
            self._set(inputCols=list(cols))

    def _fit(self, train: DataFrame) -> PipelineModel:
        cols = self.getInputCols()
        indexer = StringIndexer(inputCols=cols, outputCols=[f"_i_{c}" for c in cols], stringOrderType="frequencyAsc", handleInvalid="keep").fit(train)
        # the last level is the most frequent; unseen values come after it and are folded onto it
        folds = ", ".join(f"least(`_i_{c}`, {float(max(len(levels), 1) - 1)}D) AS `_m_{c}`" for c, levels in zip(cols, indexer.labelsArray))
        folded = SQLTransformer(statement=f"SELECT *, {folds} FROM __THIS__")
        seen = folded.transform(indexer.transform(train))
        encoder = OneHotEncoder(inputCols=[f"_m_{c}" for c in cols], outputCols=[f"{c}_vec" for c in cols], dropLast=True).fit(seen)
        dropped = ", ".join(f"`_i_{c}`, `_m_{c}`" for c in cols)
        return PipelineModel([indexer, folded, encoder, SQLTransformer(statement=f"SELECT * EXCEPT ({dropped}) FROM __THIS__")])


def one_hot_pipeline(cols: list[str]) -> Pipeline:
    """One-hot of every training level; unseen levels become all zeros."""
    idx = StringIndexer(inputCols=cols, outputCols=[f"_i_{c}" for c in cols], handleInvalid="keep",
                        stringOrderType="alphabetAsc")
    hot = OneHotEncoder(inputCols=[f"_i_{c}" for c in cols], outputCols=[f"{c}_vec" for c in cols], dropLast=True)
    return Pipeline(stages=[idx, hot])


#: Levels of a column that may be read by the driver, as columns are named by them.
MOST_LEVELS = 10_000


def training_levels(train: DataFrame, cols: list[str], most: int = MOST_LEVELS) -> dict[str, list[str]]:
    """Sorted levels per column. They are counted first: a column with more than ``most`` is refused, not read; such columns
    take ``level_dictionary`` and ``sparse_code``."""
    found = (train.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot([], cols, "name", "level")
             .filter(F.col("level").isNotNull()).distinct())
    wide = {r["name"]: r["count"] for r in found.groupBy("name").count().collect() if r["count"] > most}
    if wide:
        raise ValueError(f"more than {most} levels: {wide}")
    rows = found.orderBy("name", "level").collect()
    return {c: [r["level"] for r in rows if r["name"] == c] for c in cols}


def level_dictionary(train: DataFrame, cols: list[str], keep: int | None = None, drop_mode: bool = False) -> DataFrame:
    """name, level, n, pos: the levels of all columns numbered from 0 in the order of (name, level), however many there are.

    ``keep`` keeps the most frequent levels of each column (of equally frequent ones the first); ``drop_mode`` leaves out the
    most frequent one. Ids are ranks from a bucketed scan: nothing is read by the driver and no column is one task's work.
    """
    counts = (train.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot([], cols, "name", "level")
              .filter(F.col("level").isNotNull()).groupBy("name", "level").agg(F.count(F.lit(1)).alias("n")))
    if keep is not None or drop_mode:
        ranked = number_rows(counts.withColumn("_less", -F.col("n")), ["name"], ["_less", "level"], "_rk").drop("_less")
        least, most = (2 if drop_mode else 1), (keep or 2**62)
        counts = ranked.filter(F.col("_rk").between(least, most)).drop("_rk")
    return number_rows(counts.withColumn("_all", F.lit(0)), ["_all"], ["name", "level"], "pos").select("name", "level", "n", (F.col("pos") - 1).alias("pos"))


def sparse_code(df: DataFrame, id_col: str, cols: list[str], dictionary: DataFrame) -> DataFrame:
    """id_col, positions: the sorted positions of each row's levels in the dictionary, one row for each id; NULL and unknown
    levels have none. The design is as wide as the dictionary is long; only its ones are stored.

    All columns meet the dictionary in one join on (name, level), whose frequent levels the planner may split or broadcast.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("level")) for c in cols])
    lit_up = df.select(F.col(id_col).alias("_id"), F.inline(cells)).filter("level is not null").join(dictionary.select("name", "level", "pos"), ["name", "level"])
    own = lit_up.groupBy("_id").agg(F.array_sort(F.collect_set("pos")).alias("positions"))  # at most one for each column
    ids = df.select(F.col(id_col)).distinct()
    out = ids.join(own, F.col(id_col).eqNullSafe(F.col("_id")), "left")
    return out.select(id_col, F.coalesce("positions", F.array().cast("array<bigint>")).alias("positions"))


def dummy_code(df: DataFrame, levels: dict[str, list[str]], drop_first: bool = False) -> DataFrame:
    """Conditional 0/1 columns <col>_<level>; levels fixed from the training table."""
    out = [F.col(c) for c in df.columns if c not in levels]
    for c, values in levels.items():
        for v in values[1:] if drop_first else values:
            out.append(F.coalesce((F.col(c).cast("string") == v).cast("int"), F.lit(0)).alias(f"{c}_{v}"))
    return df.select(*out)


def standardise(df: DataFrame, train: DataFrame, cols: list[str]) -> DataFrame:
    """(x - mean) / sample sd of the training rows; moments come as one scalar subquery."""
    stats = train.agg(F.struct(*[F.struct(F.avg(c).alias("m"), F.stddev_samp(c).alias("s")).alias(c) for c in cols]).alias("s")).scalar()
    d = df.withColumn("_s", stats)
    return d.select(*[div(F.col(c) - F.col(f"_s.{c}.m"), F.col(f"_s.{c}.s")).alias(c) if c in cols else F.col(c)
                      for c in df.columns])


def min_max(df: DataFrame, train: DataFrame, cols: list[str]) -> DataFrame:
    """(x - min) / (max - min) of the training rows."""
    stats = train.agg(F.struct(*[F.struct(F.min(c).alias("a"), F.max(c).alias("b")).alias(c) for c in cols]).alias("s")).scalar()
    d = df.withColumn("_s", stats)
    return d.select(*[div(F.col(c) - F.col(f"_s.{c}.a"), F.col(f"_s.{c}.b") - F.col(f"_s.{c}.a")).alias(c)
                      if c in cols else F.col(c) for c in df.columns])


def _bin_name(edges: Column, value: Column) -> Column:
    place = F.size(F.filter(edges, lambda e: e <= value)) + 1
    return F.when(value.isNotNull(), F.concat(F.lit("q"), place.cast("string")))


def discretise(df: DataFrame, train: DataFrame, cols: list[str], bins: int = 10, max_levels: int = 31) -> DataFrame:
    """Numeric columns to codes: quantile bins where training has more than ``max_levels`` values, the
    value itself as text otherwise (fractions in full). Bins are left-closed between distinct quantile
    edges, the last closed.

    One small job counts levels: one row per column.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in cols])
    levels = train.select(F.inline(cells)).filter(F.col("v").isNotNull()).distinct()
    counts = {r[0]: r[1] for r in levels.groupBy("name").count().collect()}
    cut = [c for c in cols if counts.get(c, 0) > max_levels]
    whole = {c for c in cols if df.schema[c].dataType.typeName() in ("byte", "short", "integer", "long")}
    out = df
    picks = {}
    for c in cut:  # schema-sized loop
        names = {f"e{i}": i / bins for i in range(1, bins)}
        edges = quantile_columns(train, [], c, names).select(F.array_distinct(F.array(*names))).scalar()
        out = out.withColumn(f"_q_{c}", edges)
        picks[c] = _bin_name(F.col(f"_q_{c}"), F.col(c))
    return out.select(*[(picks[c] if c in picks else F.col(c).cast("bigint" if c in whole else "double").cast("string")).alias(c)
                        if c in cols else F.col(c) for c in df.columns])


def tokens(df: DataFrame, ids: list[str], col: str) -> DataFrame:
    """Distinct tokens of a '|' delimited text: lower case, letters and white space only."""
    clean = F.regexp_replace(F.lower(F.coalesce(F.col(col), F.lit(""))), r"[^a-z\s|]", "")
    return df.select(*ids, F.explode(F.array_distinct(F.split(clean, r"\|"))).alias("token"))



def usable_periods(df: DataFrame, period: str, y: str) -> DataFrame:
    """Periods in which no label is missing (-1 or NULL)."""
    bad = F.max((F.col(y).isNull() | (F.col(y) == -1)).cast("int"))
    return df.groupBy(period).agg(bad.alias("_bad")).filter("_bad = 0").select(period)


def expanding_folds(df: DataFrame, period: str, y: str) -> DataFrame:
    """One row per (row, fold it serves): fold, role.

    Fold t tests on period t, validates on the usable period before, trains on all earlier ones. The
    first fold has no validation period: it trains on the period before it. Rows of unusable periods
    serve no fold. The usable periods (a few) reach the rows as one scalar array.
    """
    periods = usable_periods(df, period, y).agg(F.array_sort(F.collect_list(period))).scalar()
    d = df.withColumn("_ps", periods)
    at = F.array_position("_ps", F.col(period)).cast("int")  # 1-based, 0 = unusable
    d = d.withColumn("_at", at).filter("_at > 0")
    # folds are the usable periods from the second on
    fold_pos = F.filter(F.sequence(F.lit(1), F.size("_ps")), lambda k: (k >= 2) & (k >= F.col("_at")))
    d = d.withColumn("_k", F.explode(fold_pos))
    role = (F.when(F.col("_k") == F.col("_at"), "test")
            .when((F.col("_k") == F.col("_at") + 1) & (F.col("_k") > 2), "valid").otherwise("train"))
    return (d.withColumn("fold", F.element_at("_ps", F.col("_k"))).withColumn("role", role).drop("_ps", "_at", "_k"))


def kfold(df: DataFrame, k: int, strata: list[str], id_col: str, seed: int, out: str = "fold") -> DataFrame:
    """Folds 0..k-1 of equal size per stratum, by seeded hash order."""
    d = df.withColumn("_h", draw_bits(seed, "f", F.col(id_col)))
    return number_rows(d, strata, ["_h", id_col], "_rn").withColumn(out, (F.col("_rn") - 1) % k).drop("_h", "_rn")


def holdout(df: DataFrame, frac: float, id_col: str, seed: int, out: str = "is_test") -> DataFrame:
    """Random split by a hash of the id."""
    return df.withColumn(out, (draw_uniform(seed, "h", F.col(id_col)) < frac).cast("int"))


def sample_n(df: DataFrame, keys: list[str], n: int, id_col: str, seed: int) -> DataFrame:
    """Exactly ``n`` draws with replacement per keys: all columns, weight (times drawn)."""
    rows = numbered(df, keys, [id_col])
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_sz"))
    draws = (spread_draws(sizes, keys, n, "_i")
             .select(*keys, (draw_index(F.col("_sz"), seed, "n", *[F.col(c) for c in keys], F.col("_i")) + 1).alias("_idx"))
             .groupBy(*keys, "_idx").agg(F.count(F.lit(1)).alias("weight")))
    return rows.join(draws, [*keys, "_idx"]).drop("_idx", "_n")


def permute(df: DataFrame, id_col: str, cols: list[str], seed: int) -> DataFrame:
    """``cols`` moved to other rows at random: the i-th row by id gets the i-th values by hash order."""
    left = number_rows(df.select(*[c for c in df.columns if c not in cols]), [], [id_col], "_pos")
    right = df.select(draw_bits(seed, "m", F.col(id_col)).alias("_h"), F.col(id_col).alias("_id"), *cols)
    right = number_rows(right, [], ["_h", "_id"], "_pos").drop("_h", "_id")
    return left.join(right, "_pos").drop("_pos").select(*df.columns)


def valid_holdout(df: DataFrame, labels: list[str], frac: float, id_col: str, seeds: list[int],
                  out: str = "is_test") -> DataFrame:
    """Holdout by the first seed whose held-out rows have an event of every label. All seeds are tried in
    one pass; adds seed and is_test (no rows when no seed passes)."""
    tried = df.select(id_col, *labels, F.explode(F.array(*[F.lit(s) for s in seeds])).alias("_seed"))
    held = tried.filter(draw_uniform(F.col("_seed"), "h", F.col(id_col)) < frac)
    ok = held.groupBy("_seed").agg(F.min(F.lit(1)).alias("_x"), *[F.max((F.col(c) == 1).cast("int")).alias(c) for c in labels])
    passing = ok.filter(reduce(lambda a, b: a & b, [F.col(c) == 1 for c in labels])).agg(F.min("_seed")).scalar()
    d = df.withColumn("seed", passing).filter(F.col("seed").isNotNull())
    return d.withColumn(out, (draw_uniform(F.col("seed"), "h", F.col(id_col)) < frac).cast("int"))
