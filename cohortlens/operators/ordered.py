"""Ordered scans that no hot key can push into one task.

A window partitioned by a group runs the whole group in one task. Here the order column is first cut
into buckets of about equal size (edges from one mergeable quantile sketch), the window runs inside
``(keys, bucket)``, and each bucket receives what the buckets before it hold. Bucket edges decide only
the balance of the work, never the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

MAX_BUCKETS = 4096
SKETCH_ACCURACY = 10_000


def default_buckets(df: DataFrame) -> int:
    """As many buckets as the session has shuffle partitions."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(1, min(n, MAX_BUCKETS))


def _comparable(df: DataFrame, col: str) -> Column:
    """A one-to-one, order-keeping image of an order column: numeric, or the text itself."""
    kind = df.schema[col].dataType
    c = F.col(col)
    if isinstance(kind, T.NumericType):
        return c
    if isinstance(kind, T.DateType):
        return F.unix_date(c)
    if isinstance(kind, T.TimestampNTZType):
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{col}`)")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c)
    if isinstance(kind, T.BooleanType):
        return c.cast("int")
    if isinstance(kind, T.StringType):
        return c
    raise TypeError(f"cannot order by {col}: {kind}")


def _count_below(edges: Column, value: Column, buckets: int) -> Column:
    """Number of edges below ``value``; two-level search once there are many edges."""
    if buckets <= 64:
        return F.size(F.filter(edges, lambda e: e < value))
    step = int(buckets**0.5)
    coarse = F.size(
        F.filter(F.sequence(F.lit(1), F.ceil(F.size(edges) / step).cast("int")),
                 lambda i: F.element_at(edges, F.least(i * step, F.size(edges))) < value)
    )
    start = coarse * step
    rest = F.slice(edges, start + 1, F.lit(step))
    return F.when(start >= F.size(edges), F.size(edges)).otherwise(
        start + F.size(F.filter(rest, lambda e: e < value)))


TEXT_EDGES = 4  # text edges per bucket, as they are drawn rather than computed


def _edges(source: DataFrame, col: str, order: list[str], buckets: int) -> Column:
    """Sorted distinct cut points of a column as a scalar subquery.

    Numbers: quantiles of a mergeable sketch. Text: the value with the smallest row hash in each of a fixed
    number of hash cells, a deterministic draw of rows whose size does not grow with the data.
    """
    value = _comparable(source, col)
    if isinstance(source.schema[col].dataType, T.StringType):
        known = [c for c in order if c in source.columns]
        h = F.xxhash64(*known)
        drawn = (source.filter(F.col(col).isNotNull()).groupBy(F.pmod(h, F.lit(TEXT_EDGES * buckets)).alias("_cell"))
                 .agg(F.min_by(F.col(col), h).alias("_v")))
        return drawn.agg(F.array_sort(F.collect_set("_v"))).scalar()
    probs = [i / buckets for i in range(1, buckets)]
    return source.select(F.array_sort(F.array_distinct(F.percentile_approx(value, probs, SKETCH_ACCURACY)))).scalar()


def with_buckets(df: DataFrame, order: list[str], buckets: int | None = None,
                 sketch_from: DataFrame | None = None) -> tuple[DataFrame, list[str]]:
    """Add bucket columns that follow ``order`` and hold about 1/buckets of the rows each.

    One value that fills more than a bucket becomes an edge; its rows form a bucket of their own,
    which the next order column splits further. Returns the frame and the bucket column names.
    """
    buckets = buckets or default_buckets(df)
    if buckets == 1:
        return df.withColumn("_b0", F.lit(0)), ["_b0"]
    names: list[str] = []
    inside_tie = None
    for i, col in enumerate(order):
        value = _comparable(df, col)
        source = sketch_from if sketch_from is not None and col in sketch_from.columns else df
        last = i == len(order) - 1
        df = df.withColumn(f"_e{i}", _edges(source, col, order, buckets))
        most = TEXT_EDGES * buckets if isinstance(df.schema[col].dataType, T.StringType) else buckets
        below = _count_below(F.col(f"_e{i}"), value, most)
        if last:
            code = below
        else:
            code = below * 2 + F.array_contains(F.col(f"_e{i}"), value).cast("int")
        code = F.coalesce(code, F.lit(-1))
        if inside_tie is not None:
            code = F.when(inside_tie, code).otherwise(F.lit(0))
        name = f"_b{i}"
        df = df.withColumn(name, code).drop(f"_e{i}")
        names.append(name)
        if last:
            break
        tie = F.col(name) % 2 == 1
        inside_tie = tie if inside_tie is None else inside_tie & tie
    return df, names


CELLS = 16  # hash cells of keys per bucket


def crowded_keys(source: DataFrame, keys: list[str], buckets: int | None = None) -> Column:
    """True where the keys may hold more than 1/buckets of ``source``'s rows, for any frame that has the keys.

    Rows are counted in a fixed number of hash cells of the keys, as a scalar subquery. All keys of a cell above that
    share count as crowded, so no larger group is missed; that others share its cell costs work, not the result.
    """
    buckets = buckets or default_buckets(source)
    cells = CELLS * buckets
    # 0.0 and -0.0 are one key
    floats = {k for k in keys if isinstance(source.schema[k].dataType, T.FractionalType)}
    cell = F.pmod(F.xxhash64(*[F.col(k) + F.lit(0) if k in floats else F.col(k) for k in keys]), F.lit(cells)).cast("int")
    every = source.sparkSession.range(0, cells, 1, 1).select(F.col("id").cast("int").alias("_cell"), F.lit(0).alias("_n"))
    counts = (source.select(cell.alias("_cell"), F.lit(1).alias("_n")).unionAll(every)
              .groupBy("_cell").agg(F.sum("_n").alias("_n"))
              .agg(F.array_sort(F.collect_list(F.struct("_cell", "_n"))).alias("_c"), F.sum("_n").alias("_t")))
    return F.get(counts.select(F.transform("_c", lambda c: c["_n"] * buckets > F.col("_t"))).scalar(), cell)


_EMPTY = {"sum": 0, "count": 0}


def _window_fn(kind: str, col: str) -> Column:
    return {
        "sum": lambda: F.sum(col),
        "count": lambda: F.count(F.lit(1)),
        "min": lambda: F.min(col),
        "max": lambda: F.max(col),
        "last": lambda: F.last(col, ignorenulls=True),
    }[kind]()


def _combine(kind: str, before: Column, local: Column) -> Column:
    if kind in ("sum", "count"):
        return F.coalesce(before, F.lit(0)) + F.coalesce(local, F.lit(0))
    if kind == "min":
        return F.least(before, local)
    if kind == "max":
        return F.greatest(before, local)
    return F.coalesce(local, before)


def scan(df: DataFrame, keys: list[str], order: list[str], specs: dict[str, tuple[str, str | None]],
         *, reverse: bool = False, exclusive: bool = False, totals: dict[str, str] | None = None,
         buckets: int | None = None, sketch_from: DataFrame | None = None) -> DataFrame:
    """Running aggregates over ``order`` within ``keys``.

    specs   {output: (kind, column)}, kind in sum, count, min, max, last (last non-null).
    reverse runs from the last row to the first.
    exclusive leaves the row itself out.
    totals  {output: column}: sum of the column over all rows of the keys.

    Nulls: a NULL order value comes first; rows whose key is NULL are dropped, as a group-by of the
    original data model drops them. Ties: ``order`` must end in a column that makes rows distinct
    within keys, or the tied rows must be interchangeable.
    """
    totals = totals or {}
    data, bcols = with_buckets(df, order, buckets, sketch_from)
    for k in keys:
        data = data.filter(F.col(k).isNotNull())
    direction = [F.col(c).desc() if reverse else F.col(c).asc() for c in order]
    inner = W.partitionBy(*keys, *bcols).orderBy(*direction).rowsBetween(
        W.unboundedPreceding, -1 if exclusive else 0)
    local = data.select(
        "*", *[_window_fn(kind, col).over(inner).alias(f"_l_{out}") for out, (kind, col) in specs.items()])

    def bucket_agg(kind, col):
        if kind == "last":
            pick = F.max_by if not reverse else F.min_by
            at = F.struct(*[F.col(c) for c in order])
            return pick(F.col(col), F.when(F.col(col).isNotNull(), at))
        return _window_fn(kind, col)

    summary = data.groupBy(*keys, *bcols).agg(
        *[bucket_agg(kind, col).alias(f"_s_{out}") for out, (kind, col) in specs.items()],
        *[F.sum(col).alias(f"_t_{out}") for out, col in totals.items()])
    bdir = [F.col(c).desc() if reverse else F.col(c).asc() for c in bcols]
    outer = W.partitionBy(*keys).orderBy(*bdir).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*keys)
    offsets = summary.select(
        *keys, *bcols,
        *[_window_fn("sum" if kind == "count" else kind, f"_s_{out}").over(outer).alias(f"_o_{out}")
          for out, (kind, _) in specs.items()],
        *[F.sum(f"_t_{out}").over(whole).alias(out) for out in totals])
    joined = local.join(offsets, on=[*keys, *bcols], how="inner")
    drop = {*bcols}
    return joined.select(
        *[F.col(c) for c in data.columns if c not in drop],
        *[_combine(kind, F.col(f"_o_{out}"), F.col(f"_l_{out}")).alias(out) for out, (kind, _) in specs.items()],
        *[F.col(out) for out in totals])


def number_rows(df: DataFrame, keys: list[str], order: list[str], out: str = "rn",
                buckets: int | None = None) -> DataFrame:
    """1, 2, 3, ... within keys by ``order`` (which must make rows distinct)."""
    return scan(df, keys, order, {out: ("count", None)}, buckets=buckets)


def lag_value(df: DataFrame, keys: list[str], order: list[str], col: str, out: str,
              buckets: int | None = None) -> DataFrame:
    """The value of the row before, NULL for the first row; nulls in ``col`` are kept as values."""
    boxed = df.withColumn("_box", F.struct(F.col(col).alias("v")))
    return (scan(boxed, keys, order, {"_prev": ("last", "_box")}, exclusive=True, buckets=buckets)
            .withColumn(out, F.col("_prev.v")).drop("_box", "_prev"))


def rolling(df: DataFrame, keys: list[str], order: list[str], outputs: dict[str, tuple[Column, int, int]], *,
            full_only: bool = True, block_rows: int = 100_000, keep_block: bool = False, of: str | None = None) -> DataFrame:
    """Row-frame statistics: {output: (aggregate, rows before, rows after)}.

    Rows are numbered, cut into blocks, and the rows near an edge are copied into the neighbouring
    block, so a frame never needs more than one block. ``full_only`` gives NULL on incomplete frames, where
    rows count, or with ``of`` the values of that column;
    ``keep_block`` leaves the columns _pos and _block for a following scan.
    """
    before = max(b for _, b, _ in outputs.values())
    after = max(a for _, _, a in outputs.values())
    numbered = number_rows(df, keys, order, "_pos")
    lo = F.floor((F.col("_pos") - after) / block_rows)
    hi = F.floor((F.col("_pos") + before) / block_rows)
    copies = (numbered
              .withColumn("_home", F.floor(F.col("_pos") / block_rows))
              .withColumn("_block", F.explode(F.sequence(lo, hi))))
    by_pos = W.partitionBy(*keys, "_block").orderBy("_pos")
    cols = []
    for name, (expr, b, a) in outputs.items():
        frame = by_pos.rowsBetween(-b, a)
        value = expr.over(frame)
        if full_only:
            value = F.when(F.count(F.col(of) if of else F.lit(1)).over(frame) == b + a + 1, value)
        cols.append(value.alias(name))
    out = copies.select("*", *cols).filter(F.col("_block") == F.col("_home")).drop("_home")
    return out if keep_block else out.drop("_pos", "_block")


def fill_edges(df: DataFrame, keys: list[str], order: list[str], cols: list[str],
               block: str | None = None) -> DataFrame:
    """Backward fill, then forward fill, inside keys; both directions in one pass.

    ``block`` names a column that already cuts the order into bounded pieces.
    """
    data, bcols = (df, [block]) if block else with_buckets(df, order)
    # both directions run from an unbounded start to the row (in opposite orders): such frames grow by one
    # row at a time, where "row to unbounded end" would be evaluated anew for every row
    def run(part, ordering, stop):
        return W.partitionBy(*part).orderBy(*ordering).rowsBetween(W.unboundedPreceding, stop)

    back = run([*keys, *bcols], [F.col(c).asc() for c in order], 0)
    ahead = run([*keys, *bcols], [F.col(c).desc() for c in order], 0)
    local = data.select("*", *[F.last(c, ignorenulls=True).over(ahead).alias(f"_ln_{c}") for c in cols],
                        *[F.last(c, ignorenulls=True).over(back).alias(f"_lp_{c}") for c in cols])
    at = F.struct(*[F.col(c) for c in order])
    edge = data.groupBy(*keys, *bcols).agg(
        *[F.min_by(c, F.when(F.col(c).isNotNull(), at)).alias(f"_f_{c}") for c in cols],
        *[F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(f"_l_{c}") for c in cols])
    later = run(keys, [F.col(b).desc() for b in bcols], -1)
    earlier = run(keys, [F.col(b).asc() for b in bcols], -1)
    carried = edge.select(*keys, *bcols, *[F.last(f"_f_{c}", ignorenulls=True).over(later).alias(f"_on_{c}") for c in cols],
                          *[F.last(f"_l_{c}", ignorenulls=True).over(earlier).alias(f"_op_{c}") for c in cols])
    joined = local.join(carried, on=[*keys, *bcols])
    return joined.select(*[
        F.coalesce(F.col(c), F.col(f"_ln_{c}"), F.col(f"_on_{c}"), F.col(f"_lp_{c}"), F.col(f"_op_{c}")).alias(c)
        if c in cols else F.col(c) for c in df.columns])


def exact_quantiles(df: DataFrame, keys: list[str], col: str, probs: list[float],
                    out_prob: str = "p", out_value: str = "q", weight: str | None = None) -> DataFrame:
    """Linear-interpolated quantiles, one row per keys and probability.

    Works on counts of distinct values, so no group is gathered in one place. NULLs are ignored.
    ``weight`` gives integer multiplicities.
    """
    wide = quantile_columns(df, keys, col, {f"_q{i}": p for i, p in enumerate(probs)}, weight)
    pairs = F.explode(F.array(*[F.struct(F.lit(float(p)).alias("p"), F.col(f"_q{i}").alias("q"))
                                for i, p in enumerate(probs)])).alias("_pq")
    return wide.select(*keys, pairs).select(
        *keys, F.col("_pq.p").alias(out_prob), F.col("_pq.q").alias(out_value))


def quantile_columns(df: DataFrame, keys: list[str], col: str, probs: dict[str, float],
                     weight: str | None = None) -> DataFrame:
    """As exact_quantiles, one column per probability."""
    n = F.sum(weight) if weight else F.count(F.lit(1))
    data = df.filter(F.col(col).isNotNull())
    hist = data.groupBy(*keys, F.col(col).cast("double").alias("_v")).agg(n.alias("_n"))
    hist = hist.filter(F.col("_n") > 0)
    ranked = scan(hist, keys, ["_v"], {"_before": ("sum", "_n")}, exclusive=True, totals={"_total": "_n"},
                  sketch_from=data.select(F.col(col).cast("double").alias("_v")))
    aggs = []
    for name, p in probs.items():
        pos = F.lit(float(p)) * (F.col("_total") - 1)
        lo, hi = F.floor(pos), F.ceil(pos)

        def at(k):
            return F.max(F.when((F.col("_before") <= k) & (k < F.col("_before") + F.col("_n")), F.col("_v")))

        frac = F.max(pos - lo)
        aggs.append((at(lo) + (at(hi) - at(lo)) * frac).alias(name))
    return ranked.groupBy(*keys).agg(*aggs)
