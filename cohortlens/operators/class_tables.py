"""Naive Bayes on counts for many targets at once (L9, L23, L24): any number of classes, target columns and training windows
from one count of (target, period, class, feature, level).

Features are categories, each level an indicator (Bernoulli model with Laplace 1). What meets the rows are tables of levels;
what is read by the driver is one row for each class.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from .ranking import auc
from .thresholds import pr_grid, threshold_balance


def _levels(df: DataFrame, ids: list[str], cats: list[str]) -> DataFrame:
    """ids, name, level: one row for each category of a row that is not NULL."""
    cells = F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").cast("string").alias("level")) for c in cats])
    return df.select(*ids, F.explode(cells).alias("_c")).select(*ids, "_c.*").filter("level is not null")


# --- classes of one column (L24) ----------------------------------------------------------------------

def class_posteriors(train: DataFrame, df: DataFrame, col: str, cats: list[str], out: str = "posterior") -> tuple[list, DataFrame]:
    """(classes in order, df with the normalised class probabilities as an array in that order).

    Counts of the rows of ``train`` where ``col`` is known, one pass. A NULL or unseen level has all indicators off.
    """
    known = train.filter(F.col(col).isNotNull())
    sizes = sorted((r[0], r[1]) for r in known.groupBy(col).count().collect())  # one row for each class
    classes, n = [k for k, _ in sizes], [float(c) for _, c in sizes]
    if not classes:
        return [], df.withColumn(out, F.lit(None).cast("array<double>"))
    total = sum(n)
    counts = _levels(known.select(F.col(col).alias("_k"), *cats), ["_k"], cats).groupBy("name", "level").agg(
        F.array(*[F.sum((F.col("_k") == F.lit(k)).cast("double")) for k in classes]).alias("c"))
    p = F.transform("c", lambda v, i: (v + 1) / (F.get(F.array(*[F.lit(x) for x in n]), i) + 2))
    table = cut_lineage(counts.withColumn("p", p).select("name", "level", F.transform("p", lambda v: F.ln(v / (1 - v))).alias("on"), F.transform("p", lambda v: F.ln(1 - v)).alias("off")))
    base = table.agg(F.array(*[F.sum(F.col("off")[i]) + F.log(F.lit(x / total)) for i, x in enumerate(n)]).alias("b"))
    own = "_eta"
    while own in df.columns:
        own = "_" + own
    zero = F.array(*[F.lit(0.0)] * len(classes))
    d = df.withColumn(own, F.coalesce(base.scalar(), F.array(*[F.log(F.lit(x / total)) for x in n])))
    for c in cats:  # schema-sized loop; tables of levels are broadcast by their size
        part = table.filter(F.col("name") == c).select(F.col("level").alias(f"{own}_l"), F.col("on").alias(f"{own}_on"))
        d = d.join(part, F.col(f"`{c}`").cast("string") == F.col(f"{own}_l"), "left")
        d = d.withColumn(own, F.zip_with(own, F.coalesce(f"{own}_on", zero), lambda a, b: a + b)).drop(f"{own}_l", f"{own}_on")
    raised = F.transform(own, lambda v: F.exp(v - F.array_max(own)))
    whole = F.aggregate(raised, F.lit(0.0), lambda a, v: a + v)
    return classes, d.withColumn(out, F.transform(raised, lambda v: F.round(v / whole, 9))).select(*[c for c in df.columns if c != out], out)


def impute_classes(df: DataFrame, col: str, cats: list[str]) -> DataFrame:
    """Fill NULLs of a column of several classes from one model.

    Each class but the first has the threshold on its posterior that keeps its share among the known rows; of the classes above
    their thresholds the one furthest above wins, and where none is, the first class. Rows and columns stay; a column
    without a known value stays NULL.
    """
    mark = "_posterior"
    while mark in df.columns:
        mark = "_" + mark
    classes, scored = class_posteriors(df, df, col, cats, mark)
    if len(classes) < 2:
        return df if not classes else df.select(*[F.coalesce(F.col(c), F.lit(classes[0])).alias(c) if c == col else F.col(c) for c in df.columns])
    places = list(range(1, len(classes)))
    cells = F.array(*[F.struct(F.lit(i).alias("k"), (F.col(col) == F.lit(classes[i])).cast("bigint").alias("y"), F.col(mark)[i].alias("score")) for i in places])
    cuts = threshold_balance(scored.filter(F.col(col).isNotNull()).select(F.inline(cells)), ["k"])
    found = cuts.agg(F.map_from_entries(F.collect_list(F.struct("k", "thresh"))).alias("m")).scalar()  # one entry for each class
    d = scored.withColumn(mark, F.struct(F.col(mark).alias("p"), found.alias("t")))
    margins = [F.struct((F.col(mark)["p"][i] - F.try_element_at(F.col(mark)["t"], F.lit(i))).alias("m"), F.lit(classes[i]).alias("k")) for i in places]
    top = F.greatest(*margins) if len(margins) > 1 else margins[0]
    pick = F.when(top["m"] > 0, top["k"]).otherwise(F.lit(classes[0])).cast(df.schema[col].dataType)
    return d.select(*[F.coalesce(F.col(c), pick).alias(c) if c == col else F.col(c) for c in df.columns])


# --- many 0/1 columns and windows (L23) ----------------------------------------------------------------

def gate_columns(df: DataFrame, cols: list[str], period: str, cats: list[str], id_col: str, min_precision: float = 0.1, min_recall: float = 0.2) -> DataFrame:
    """name, auc, precision, recall, impute for every column and test period at once: train on the periods before, test on the
    period, means over the threshold grid and the test periods; ``impute`` where both means are high enough.

    Rows are counted once by (column, period, class, category, level) and cumulated over periods on the counts; test rows meet
    the counts of their own window. The first period in which a column is known is not tested; a window without both
    classes gives nothing.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("col"), F.col(f"`{c}`").cast("int").alias("y")) for c in cols])
    rows = df.select(F.col(id_col).alias("id"), F.col(period).alias("t"), *[F.col(f"`{c}`") for c in cats], F.explode(cells).alias("_y"))
    rows = cut_lineage(rows.select("id", "t", *cats, "_y.*").filter(F.col("y").isin(0, 1)))
    sizes = rows.groupBy("col", "t").agg(F.sum("y").alias("n1"), F.sum(1 - F.col("y")).alias("n0"))
    counts = cut_lineage(_levels(rows, ["col", "t", "y"], cats).groupBy("col", "name", "level", "t").agg(F.sum("y").alias("c1"), F.sum(1 - F.col("y")).alias("c0")))
    folds = cut_lineage(sizes)
    before = folds.select("col", F.col("t").alias("fold")).join(folds, "col").filter("t < fold").groupBy("col", "fold").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    before = before.filter("n1 > 0 and n0 > 0")
    # periods are few: a level's counts are added up over the periods before each fold
    seen = counts.join(before, "col").filter("t < fold").groupBy("col", "fold", "name", "level").agg(
        F.sum("c1").alias("c1"), F.sum("c0").alias("c0"), F.max("n1").alias("n1"), F.max("n0").alias("n0"))
    p1, p0 = (F.col("c1") + 1) / (F.col("n1") + 2), (F.col("c0") + 1) / (F.col("n0") + 2)
    table = cut_lineage(seen.select("col", "fold", "name", "level", (F.ln(p1 / (1 - p1)) - F.ln(p0 / (1 - p0))).alias("on"), (F.ln(1 - p1) - F.ln(1 - p0)).alias("off")))
    base = before.join(table.groupBy("col", "fold").agg(F.sum("off").alias("off")), ["col", "fold"], "left").select(
        "col", F.col("fold").alias("t"), (F.ln(F.col("n1") / F.col("n0")) + F.coalesce("off", F.lit(0.0))).alias("base"))
    lit_up = _levels(rows, ["col", "t", "id"], cats).join(table.withColumnRenamed("fold", "t"), ["col", "t", "name", "level"]).groupBy("col", "t", "id").agg(F.sum("on").alias("on"))
    scored = rows.select("col", "t", "id", "y").join(base, ["col", "t"]).join(lit_up, ["col", "t", "id"], "left")
    scored = cut_lineage(scored.select("col", "t", "y", F.round(1 / (1 + F.exp(-(F.col("base") + F.coalesce("on", F.lit(0.0))))), 9).alias("score")))
    grid = pr_grid(scored, ["col", "t"], 200).groupBy("col", "t").agg(F.avg("precision").alias("precision"), F.avg("tpr").alias("recall"))
    each = auc(scored, ["col", "t"]).select("col", "t", "auc").join(grid, ["col", "t"])
    mean = each.groupBy(F.col("col").alias("name")).agg(*[F.avg(c).alias(c) for c in ("auc", "precision", "recall")])
    return mean.withColumn("impute", ((F.col("precision") > min_precision) & (F.col("recall") > min_recall)).cast("int"))
