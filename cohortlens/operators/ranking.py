"""Grouped ranking metrics: AUROC, its decomposition, and what is derived from them.

Conventions: y is 0/1 (other labels, and NULL scores, are left out), ties between a positive and a
negative count one half, a metric without both classes is NULL. All metrics work on the histogram
(keys, score) -> positives, negatives, so what moves over the network is distinct scores. Groups that fit into a
task are the exception: their rows are moved once and ranked as they are, as few of them share a score.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.draws import draw_index
from .draws import spread_draws
from .ordered import crowded_keys, number_rows, scan, with_buckets


def div(a: Column, b: Column) -> Column:
    """a / b as double, NULL when b is 0."""
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def labelled(df: DataFrame, keys: list[str], y: str = "y", s: str = "score", weight: str | None = None) -> DataFrame:
    """The scored rows: keys, s, p (weight of a positive, else 0), n (of a negative)."""
    w = F.col(weight) if weight else F.lit(1).cast("bigint")
    return df.filter(F.col(y).isin(0, 1) & F.col(s).isNotNull()).select(
        *keys, s, F.when(F.col(y) == 1, w).otherwise(0).alias("p"), F.when(F.col(y) == 0, w).otherwise(0).alias("n"))


def labelled_cells(df: DataFrame, own: list[str], cells: list[Cell], weight: str | None = None) -> tuple[DataFrame, list[str]]:
    """The scored rows, one for each score column that cells name, not for each cell: _of (which score), ``own`` columns, _s,
    and p and n with a suffix for each label column. Returns them and the suffixes. Scores are compared as doubles."""
    w = F.col(weight) if weight else F.lit(1).cast("bigint")
    labels, scores = (list(dict.fromkeys(c)) for c in list(zip(*cells))[1:])
    one = [F.when(F.col(y) == v, w).otherwise(0).alias(f"{c}{i}")
           for i, y in enumerate(labels) for c, v in (("p", 1), ("n", 0))]
    of = F.array(*[F.struct(F.lit(i).alias("_of"), F.col(s).cast("double").alias("_s")) for i, s in enumerate(scores)])
    rows = df.select(*own, *one, F.explode(of).alias("_o")).select("_o._of", *own, "_o._s", *[f"{c}{i}" for i in range(len(labels)) for c in "pn"])
    return rows.filter(F.col("_s").isNotNull()), [str(i) for i in range(len(labels))]


def of_cells(won: DataFrame, keys: list[str], cells: list[Cell], own: Sequence[str] = ()) -> DataFrame:
    """keys, own -> p, n, num, den of each cell, from sums by _of and own with a suffix for each label; cells without a row are left out."""
    labels, scores = (list(dict.fromkeys(c)) for c in list(zip(*cells))[1:])
    each = F.array(*[F.struct(F.lit(scores.index(s)).alias("_cell_of"), *[F.lit(v).alias(k) for k, v in zip(keys, values)],
                              *[F.col(f"{c}{labels.index(y)}").alias(c) for c in ("p", "n", "num", "den")]) for values, y, s in cells])
    return (won.select("_of", *own, F.explode(each).alias("_c")).filter(F.col("_c._cell_of") == F.col("_of")).select(*own, "_c.*").drop("_cell_of")
            .filter(F.col("p") + F.col("n") > 0))


def merged(rows: DataFrame, keys: list[str], s: str, labels: Sequence[str] = ("",)) -> DataFrame:
    """(keys, s) -> p positives, n negatives (of each label), of rows or of a finer histogram."""
    return rows.groupBy(*keys, s).agg(*[F.sum(c + x).alias(c + x) for x in labels for c in "pn"])


def score_histogram(df: DataFrame, keys: list[str], y: str = "y", s: str = "score",
                    weight: str | None = None) -> DataFrame:
    """(keys, s) -> p positives, n negatives."""
    return merged(labelled(df, keys, y, s, weight), keys, s)


ALL = "all"
Cell = tuple[tuple, str, str]  # values of the keys, label column, score column


def with_all(df: DataFrame, period: str, own: list[str], overall: list[str]) -> DataFrame:
    """Each row twice: at its period as text, with the columns ``own``, and at period 'all' with ``overall`` under the
    names of ``own``. ``_all`` tells the two apart; a row without a period is at 'all' only."""
    rest = [c for c in df.columns if c not in {period, *own, *overall}]
    at = F.array(*[F.struct(F.lit(i).alias("_all"), when.alias(period), *[F.col(c).alias(o) for c, o in zip(cols, own)])
                   for i, (when, cols) in enumerate(((F.col(period).cast("string"), own), (F.lit(ALL), overall)))])
    return df.select(*rest, F.explode(at).alias("_when")).select(*rest, "_when.*").filter(F.col(period).isNotNull())


def _won_inside(data: DataFrame, part: list[str], s: str, period: str | None = None, labels: Sequence[str] = ("",)) -> DataFrame:
    """part -> p, n, num: pairs won inside the part. ``data`` are rows or a histogram: ranges of equal scores are one step.

    With a period: by period and over all of them (``with_all``), from one shuffle by the part. Several labels (suffixes
    of p, n and num) are ranked in one order.
    """
    # sorts compare one number before the keys, which are mostly text
    data = data.select(F.xxhash64(*part).alias("_at"), *part, *([period] if period else []), s, *[c + x for x in labels for c in "pn"])
    grains = [["_at", *part]] if period is None else [["_at", *part], ["_at", *part, period]]
    for i, by in enumerate(grains):
        upto = W.partitionBy(*by).orderBy(s).rangeBetween(W.unboundedPreceding, W.currentRow)
        data = data.select("*", *[F.sum(c + x).over(upto).cast("double").alias(f"_{c}{i}{x}") for x in labels for c in "np"])
    # up: pairs won or tied, down: lost or tied
    sums = data.groupBy(*grains[-1]).agg(*[e for x in labels for e in (
        F.sum(f"p{x}").alias(f"p{x}"), F.sum(f"n{x}").alias(f"n{x}"),
        *[y for i in range(len(grains)) for y in (F.sum(F.col(f"p{x}") * F.col(f"_n{i}{x}")).alias(f"_up{i}{x}"),
                                                  F.sum(F.col(f"n{x}") * F.col(f"_p{i}{x}")).alias(f"_down{i}{x}"))])])
    if period:
        part = [*part, "_all", period]
        own, overall = ([f"_{c}{i}{x}" for x in labels for c in ("up", "down")] for i in (1, 0))
        counts = [c + x for x in labels for c in "pn"]
        sums = (with_all(sums, period, own, overall).groupBy("_at", *part)
                .agg(*[F.sum(c).alias(o) for c, o in (*zip(counts, counts), *zip(own, overall))]))
    return sums.select(*part, *[e for x in labels for e in (
        f"p{x}", f"n{x}", ((F.col(f"_up0{x}") - F.col(f"_down0{x}") + _pairs(x)) / 2).alias(f"num{x}"))])


def _pairs(label: str) -> Column:
    return F.col(f"p{label}").cast("double") * F.col(f"n{label}").cast("double")


def _over_buckets(parts: DataFrame, keys: list[str], bcols: list[str], labels: Sequence[str] = ("",)) -> DataFrame:
    """keys -> p, n, num: a bucket's positives also win against the negatives of the buckets below.

    Buckets meet as sums; no row is joined to what the buckets before it hold.
    """
    upto = W.partitionBy(*keys).orderBy(*bcols).rowsBetween(W.unboundedPreceding, -1)
    won = [(F.col(f"num{x}") + F.col(f"p{x}").cast("double") * F.coalesce(F.sum(f"n{x}").over(upto), F.lit(0)).cast("double"))
           .alias(f"num{x}") for x in labels]
    return (parts.select(*keys, *[c + x for x in labels for c in "pn"], *won).groupBy(*keys)
            .agg(*[F.sum(c + x).alias(c + x) for x in labels for c in ("p", "n", "num")]))


def _rated(won: DataFrame, keys: list[str]) -> DataFrame:
    """keys -> n1, n0, num, den, auc."""
    return (won.select(*keys, F.col("p").alias("n1"), F.col("n").alias("n0"), "num")
            .withColumn("den", F.col("n1").cast("double") * F.col("n0").cast("double"))
            .withColumn("auc", div(F.col("num"), F.col("den"))))


def _keyed(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows without a NULL key."""
    for k in keys:
        df = df.filter(F.col(k).isNotNull())
    return df


def _won_of_few(hist: DataFrame, keys: list[str], s: str, sketch_from: DataFrame | None = None,
                labels: Sequence[str] = ("",)) -> DataFrame:
    """keys -> p, n, num, for few keys that hold many scores: every key is cut into buckets of scores."""
    hist = _keyed(hist, keys)
    some = sum((F.col(c + x) for x in labels for c in "pn"), F.lit(0)) > 0
    data, bcols = with_buckets(hist, [s], sketch_from=hist.filter(some) if sketch_from is None else sketch_from)
    return _over_buckets(_won_inside(data, [*keys, *bcols], s, labels=labels), keys, bcols, labels)


def _won_of_groups(rows: DataFrame, keys: list[str], s: str, period: str | None = None, labels: Sequence[str] = ("",)) -> DataFrame:
    """keys -> p, n, num, for many groups of any size."""
    rows = _keyed(rows, keys)
    crowded = crowded_keys(rows, keys)
    some = rows.filter(crowded)
    grain = [*keys, period] if period else keys
    out = [*keys, "_all", period] if period else keys
    data, bcols = with_buckets(merged(some, grain, s, labels), [s], sketch_from=some.select(s))
    cut = _over_buckets(_won_inside(data, [*keys, *bcols], s, period, labels), out, bcols, labels)
    return _won_inside(rows.filter(~crowded), keys, s, period, labels).unionByName(cut)


def auc_from_histogram(hist: DataFrame, keys: list[str], s: str = "score",
                       sketch_from: DataFrame | None = None) -> DataFrame:
    """keys -> n1, n0, num (pairs won), den (pairs), auc, for few keys that hold many scores.

    Every key is cut into buckets of scores. Their edges come from ``sketch_from``, or from the histogram: read with
    all its columns, so that its shuffle runs once for both.
    """
    return _rated(_won_of_few(hist, keys, s, sketch_from), keys)


def auc_of_groups(rows: DataFrame, keys: list[str], s: str = "score", period: str | None = None) -> DataFrame:
    """As auc_from_histogram, from ``labelled`` rows of many groups of any size.

    Only groups that hold more than a bucket's share of the rows are counted by score and cut into buckets; there
    are few of them. The others are moved once, whole, and ranked as they lie. With a period: also over all
    periods (``with_all``), from the same shuffle.
    """
    return _rated(_won_of_groups(rows, keys, s, period), [*keys, "_all", period] if period else keys)


def auc(df: DataFrame, keys: list[str], y: str = "y", s: str = "score",
        weight: str | None = None) -> DataFrame:
    """AUROC by keys."""
    return auc_from_histogram(score_histogram(df, keys, y, s, weight), keys, s, df.select(s))


def auc_by_group(df: DataFrame, keys: list[str], g: str, y: str = "y", s: str = "score") -> DataFrame:
    """Group table: n1, n0, r_s (rank sum of positives), n0n1, auc.

    Groups without a positive are left out; groups without a negative stay with 0 pairs.
    """
    t = auc_of_groups(labelled(df, [*keys, g], y, s), [*keys, g], s).filter(F.col("n1") > 0)
    n1 = F.col("n1").cast("double")
    return t.select(*keys, g, "n1", "n0", (F.col("num") + n1 * (n1 + 1) / 2).alias("r_s"),
                    F.col("den").alias("n0n1"), "auc")


def _decomposed(total: DataFrame, groups: DataFrame, k: list[str], keys: list[str]) -> DataFrame:
    """The three parts from the tables of AUROC by k and by group; ``keys`` are those to return."""
    within = groups.groupBy(*k).agg(F.sum("num").alias("num_w"), F.sum("den").alias("den_w"))
    both = total.join(within, on=k)
    parts = F.array(
        F.struct(F.lit("total").alias("tt"), F.col("num").alias("num"), F.col("den").alias("den")),
        F.struct(F.lit("within").alias("tt"), F.col("num_w").alias("num"), F.col("den_w").alias("den")),
        F.struct(F.lit("between").alias("tt"), (F.col("num") - F.col("num_w")).alias("num"),
                 (F.col("den") - F.col("den_w")).alias("den")))
    return (both.select(*keys, "n1", "n0", F.explode(parts).alias("_part"))
            .select(*keys, F.col("_part.tt").alias("tt"),
                    div(F.col("_part.num"), F.col("_part.den")).alias("auc"),
                    F.col("_part.den").alias("den"), "n1", "n0"))


def _decompose_cells(df: DataFrame, keys: list[str], g: str, cells: list[Cell], weight: str | None = None, period: str | None = None) -> DataFrame:
    """``auc_decompose`` of every cell: a case is moved and sorted once for each score column, with all its labels. With a
    period: ``decompose_all``."""
    at = [period] if period else []
    rows, labels = labelled_cells(df, [*at, g], cells, weight)
    own = ["_all", *at] if period else []

    def sums(won: DataFrame) -> DataFrame:
        return of_cells(won.groupBy("_of", *own).agg(*[e for x in labels for e in (
            *[F.sum(c + x).alias(c + x) for c in ("p", "n", "num")], F.sum(_pairs(x)).alias(f"den{x}"))]), keys, cells, own)

    flat = merged(rows, ["_of", *at], "_s", labels)
    if period:
        flat = merged(with_all(flat, period, [], []), ["_of", *own], "_s", labels)
    total = sums(_won_of_few(flat, ["_of", *own], "_s", labels=labels))
    return _decomposed(total.withColumnsRenamed({"p": "n1", "n": "n0"}), sums(_won_of_groups(rows, ["_of", g], "_s", period, labels)),
                       [*keys, *own], [*keys, *at])


def auc_decompose(df: DataFrame, keys: list[str], g: str, y: str = "y", s: str = "score",
                  weight: str | None = None, cells: list[Cell] | None = None) -> DataFrame:
    """AUROC split exactly into total, within-group and between-group parts.

    total * den_total = within * den_within + between * den_between; n1, n0 belong to the total. With ``cells``, a row of
    ``df`` is a case with several labels and scores as columns, and each cell is a label and a score that meet at
    its values of the keys; as if the case came once for each cell, but its scores are not copied.
    """
    if cells:
        return _decompose_cells(df, keys, g, cells, weight)
    rows = labelled(df, [*keys, g], y, s, weight)
    if not keys:
        rows = rows.withColumn("_all", F.lit(1))
    k = keys or ["_all"]
    total = auc_from_histogram(merged(_keyed(rows, k), k, s), k, s)
    return _decomposed(total, auc_of_groups(rows, [*k, g], s), k, keys)


def decompose_all(df: DataFrame, keys: list[str], period: str, g: str, y: str = "y",
                  s: str = "score", cells: list[Cell] | None = None) -> DataFrame:
    """Decomposition by period and over all periods ('all'); rows and their counts are moved once for both. ``cells``: as
    in ``auc_decompose``."""
    if cells:
        return _decompose_cells(df, keys, g, cells, period=period)
    rows = labelled(df, [*keys, period, g], y, s)
    k = [*keys, "_all", period]
    flat = merged(with_all(merged(rows, [*keys, period], s), period, [], []), k, s)
    total = auc_from_histogram(flat, k, s)
    return _decomposed(total, auc_of_groups(rows, [*keys, g], s, period), k, [*keys, period])


def sampled_pair_auc(df: DataFrame, keys: list[str], n: int, seed: int, id_col: str, y: str = "y",
                     s: str = "score", tie: float = 0.0) -> DataFrame:
    """AUROC estimate from ``n`` drawn (positive, negative) pairs per keys; ties score ``tie``.

    Draws are positions in the class ordered by (score, id). Returns keys, n1, n0, auc.
    """
    k = keys or ["_all"]
    base = df.filter(F.col(y).isin(0, 1) & F.col(s).isNotNull())
    if not keys:
        base = base.withColumn("_all", F.lit(1))
    rows = number_rows(base.select(*k, y, s, id_col), [*k, y], [s, id_col], "_pos")
    size = base.groupBy(*k).agg(F.sum(F.when(F.col(y) == 1, 1).otherwise(0)).alias("n1"),
                                F.sum(F.when(F.col(y) == 0, 1).otherwise(0)).alias("n0"))
    draws = (spread_draws(size.filter((F.col("n1") > 0) & (F.col("n0") > 0)), k, n, "_i")
             .withColumn("_p1", draw_index(F.col("n1"), seed, 1, *[F.col(c) for c in k], F.col("_i")) + 1)
             .withColumn("_p0", draw_index(F.col("n0"), seed, 0, *[F.col(c) for c in k], F.col("_i")) + 1))
    pos = rows.filter(F.col(y) == 1).select(*k, F.col("_pos").alias("_p1"), F.col(s).alias("_s1"))
    neg = rows.filter(F.col(y) == 0).select(*k, F.col("_pos").alias("_p0"), F.col(s).alias("_s0"))
    won = (F.when(F.col("_s1") > F.col("_s0"), 1.0).when(F.col("_s1") == F.col("_s0"), tie).otherwise(0.0))
    out = (draws.join(pos, [*k, "_p1"]).join(neg, [*k, "_p0"]).groupBy(*k)
           .agg(F.max("n1").alias("n1"), F.max("n0").alias("n0"), F.avg(won).alias("auc")))
    return out if keys else out.drop("_all")


def auc_decompose_sampled(df: DataFrame, g: str, n: int, seed: int, id_col: str, y: str = "y",
                          s: str = "score") -> DataFrame:
    """Sampled total, within and between: ``n`` draws in each two-class group, as many for the total."""
    by_group = sampled_pair_auc(df, [g], n, seed, id_col, y, s, tie=0.5)
    pairs = F.col("n1").cast("double") * F.col("n0").cast("double")
    within = by_group.agg(div(F.sum(F.col("auc") * pairs), F.sum(pairs)).alias("within"),
                          F.sum(pairs).alias("den_w"), F.lit(1).alias("_all"))
    base = df.filter(F.col(y).isin(0, 1) & F.col(s).isNotNull()).withColumn("_all", F.lit(1))
    rows = number_rows(base.select("_all", y, s, id_col), ["_all", y], [s, id_col], "_pos")
    size = base.agg(F.struct(F.sum(F.when(F.col(y) == 1, 1).otherwise(0)).alias("n1"),
                             F.sum(F.when(F.col(y) == 0, 1).otherwise(0)).alias("n0")).alias("_s")).scalar()
    draws = (spread_draws(by_group.select(g), [g], n, "_i").withColumn("_s", size).select(g, "_i", F.lit(1).alias("_all"), "_s.*")
             .withColumn("_p1", draw_index(F.col("n1"), seed, "t1", F.col(g), F.col("_i")) + 1)
             .withColumn("_p0", draw_index(F.col("n0"), seed, "t0", F.col(g), F.col("_i")) + 1))
    pos = rows.filter(F.col(y) == 1).select(F.col("_pos").alias("_p1"), F.col(s).alias("_s1"))
    neg = rows.filter(F.col(y) == 0).select(F.col("_pos").alias("_p0"), F.col(s).alias("_s0"))
    won = F.when(F.col("_s1") > F.col("_s0"), 1.0).when(F.col("_s1") == F.col("_s0"), 0.5).otherwise(0.0)
    total = (draws.join(pos, "_p1").join(neg, "_p0").groupBy("_all")
             .agg(F.avg(won).alias("total"),
                  F.max(F.col("n1").cast("double") * F.col("n0").cast("double")).alias("den")))
    return total.join(within, "_all").select(
        "total", "within",
        div(F.col("total") * F.col("den") - F.col("within") * F.col("den_w"),
            F.col("den") - F.col("den_w")).alias("between"))


def auc_ordinal(df: DataFrame, keys: list[str], level: str, s: str, levels: Iterable[int]) -> DataFrame:
    """Every higher level against all lower levels, pooled into one ratio."""
    levels = sorted(levels)
    hist = (df.filter(F.col(level).isNotNull() & F.col(s).isNotNull()).groupBy(*keys, s)
            .agg(*[F.sum(F.when(F.col(level) == v, 1).otherwise(0)).alias(f"_c{i}")
                   for i, v in enumerate(levels)]))
    ranked = scan(hist, keys, [s], {f"_b{i}_": ("sum", f"_c{i}") for i in range(len(levels))}, exclusive=True)
    won, counts = F.lit(0.0), [F.sum(f"_c{i}").alias(f"_n{i}") for i in range(len(levels))]
    for i in range(1, len(levels)):
        for j in range(i):
            won = won + F.col(f"_c{i}").cast("double") * (
                F.col(f"_b{j}_").cast("double") + F.col(f"_c{j}").cast("double") / 2)
    out = ranked.groupBy(*keys).agg(F.sum(won).alias("num"), *counts)
    den = F.lit(0.0)
    for i in range(1, len(levels)):
        for j in range(i):
            den = den + F.col(f"_n{i}").cast("double") * F.col(f"_n{j}").cast("double")
    return out.select(*keys, div(F.col("num"), den).alias("auc"), den.alias("den"))


def auc_pairwise(df: DataFrame, label: str, score_cols: dict[int, str]) -> DataFrame:
    """Each pair of classes scored by the higher class's column: y0, y1, auc."""
    classes = sorted(score_cols)
    cells = F.array(*[
        F.struct(F.lit(lo).alias("y0"), F.lit(hi).alias("y1"), F.col(score_cols[hi]).cast("double").alias("score"))
        for hi in classes for lo in classes if lo < hi])
    long = (df.filter(F.col(label).isin(*classes))
            .select(label, F.explode(F.filter(cells, lambda c: (c["y0"] == F.col(label)) | (c["y1"] == F.col(label)))).alias("_c"))
            .select("_c.*", (F.col(label) == F.col("_c.y1")).cast("int").alias("y")))
    return auc(long, ["y0", "y1"]).select("y0", "y1", "auc", "den")


def avg_precision(df: DataFrame, keys: list[str], y: str = "y", s: str = "score") -> DataFrame:
    """Average precision: recall steps times precision at each distinct score, from the top."""
    hist = score_histogram(df, keys, y, s)
    ranked = scan(hist, keys, [s], {"_tp": ("sum", "p"), "_fp": ("sum", "n")}, reverse=True)
    part = F.col("p").cast("double") * F.col("_tp") / (F.col("_tp") + F.col("_fp"))
    return ranked.groupBy(*keys).agg(div(F.sum(part), F.sum("p")).alias("ap"))


def log_loss(df: DataFrame, keys: list[str], y: str = "y", p: str = "score", eps: float = 1e-15) -> DataFrame:
    """Mean negative log likelihood; scores are kept away from 0 and 1 by ``eps``."""
    q = F.least(F.greatest(F.col(p), F.lit(eps)), F.lit(1 - eps))
    return df.filter(F.col(y).isin(0, 1)).groupBy(*keys).agg(
        F.avg(-F.ln(F.when(F.col(y) == 1, q).otherwise(1 - q))).alias("log_loss"))


def r_squared(df: DataFrame, keys: list[str], y: str, yhat: str) -> DataFrame:
    """1 - residual over total sum of squares."""
    return df.groupBy(*keys).agg(
        (1 - div(F.sum((F.col(y) - F.col(yhat)) ** 2), F.var_pop(y) * F.count(y))).alias("r2"))


def auc_by_lookup(df: DataFrame, dim: DataFrame, on: list[str], by: list[str], y: str = "y",
                  s: str = "score") -> DataFrame:
    """AUROC by an attribute of the group (title, main group, risk bin), in one pass."""
    return auc(df.join(dim, on=on), by, y, s)


def gain_share(total: Column, group_only: Column) -> Column:
    """Share of the signal a model adds beyond the group alone, floored at 0."""
    return F.greatest(F.lit(0.0), 1 - div(group_only - 0.5, total - 0.5))


def select_best(within: DataFrame) -> DataFrame:
    """Best label version per outcome by mean within AUROC, then best model by pair-weighted AUROC.

    Input: outcome, version, method, model, auc, den. Ties: lower version, method and model name.
    """
    gg = ["outcome", "version", "method"]
    versions = within.groupBy(*gg).agg(F.avg("auc").alias("_m"))
    best = (versions.groupBy("outcome")
            .agg(F.min(F.struct((-F.round("_m", 12)).alias("m"), F.col("version"), F.col("method"))).alias("_b"))
            .select("outcome", F.col("_b.version").alias("version"), F.col("_b.method").alias("method")))
    models = (within.join(best, gg).groupBy(*gg, "model")
              .agg(div(F.sum(F.col("auc") * F.col("den")), F.sum("den")).alias("auc")))
    return (models.groupBy(*gg)
            .agg(F.min(F.struct((-F.round("auc", 12)).alias("m"), F.col("model"), F.col("auc"))).alias("_b"))
            .select(*gg, F.col("_b.model").alias("model"), F.col("_b.auc").alias("auc")))


def match_coverage(agg: DataFrame, sub: DataFrame, on: list[str]) -> DataFrame:
    """Aggregate scores of the cases the sub-models scored too."""
    return agg.join(sub.select(*on), on=on, how="left_semi")


def auc_group_mean(groups: DataFrame, keys: list[str]) -> DataFrame:
    """Group AUROCs averaged plainly and weighted by events."""
    ok = groups.filter(F.col("auc").isNotNull())
    return ok.groupBy(*keys).agg(F.avg("auc").alias("auc_mean"),
                                 div(F.sum(F.col("auc") * F.col("n1")), F.sum("n1")).alias("auc_weighted"),
                                 F.count(F.lit(1)).alias("groups"))
