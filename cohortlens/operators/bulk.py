"""Bulk bootstrap of ranking metrics: all replicates in one pass over sorted rows.

A row carries its multiplicity in each replicate and is never opened to replicates: either a hash, of which a task makes
independent Poisson(1) draws (a function of (seed, row id, replicate), so no draw is shuffled or joined), or the counted
draws of an exact resample, packed. Rows go to (keys, group, score bucket), are sorted by score there and stream through Arrow batches;
for each stretch of equal scores the weights of all replicates are added up as one matrix. What leaves a task are sums by
replicate. Groups of ordinary size are one stretch of one task; a large group is cut at score quantiles, as the total is,
and its buckets are put together from their sums.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.draws import draw_bits
from ..session import cut_lineage
from .ordered import _count_below, default_buckets
from .ranking import div
from .resample import POISSON_STEPS, with_weights

#: Rows from which a group is cut into score buckets; rows whose weights are held at once.
LARGE_GROUP, ROWS_AT_ONCE = 100_000, 4096


def poisson_weights(ids: np.ndarray, reps: int) -> np.ndarray:
    """(rows, replicates) Poisson(1) multiplicities from 64-bit row hashes."""
    x = ids.astype(np.uint64)[:, None] + np.arange(1, reps + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    out = np.zeros(x.shape, np.uint8)
    for step in POISSON_STEPS:
        out += x >= np.uint64(min(step, 1 - 2.0 ** -53) * 2.0 ** 64)
    return out


def pack_weights(w: np.ndarray) -> pa.Array:
    """A row's weights as two bytes each."""
    if w.size and w.max() > 65535:
        raise ValueError("a row is drawn more than 65,535 times in a replicate")
    packed = np.ascontiguousarray(w, "<u2")
    ends = np.arange(0, packed.nbytes + 1, 2 * w.shape[1], dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(w), [None, pa.py_buffer(ends), pa.py_buffer(packed.tobytes())])


def _weights_of(h: pa.Array, reps: int) -> np.ndarray:
    """(rows, replicates) from hashes or packed weights."""
    if pa.types.is_integer(h.type):
        return poisson_weights(h.to_numpy(zero_copy_only=False), reps)
    return np.frombuffer(b"".join(h.to_pylist()), "<u2").reshape(len(h), reps)


def _streamed(reps: int, n_keys: int):
    """For mapInArrow over rows (segment, whole, key..., y, s, h) sorted by segment and s: per unfinished segment its
    (p, n, u) by replicate, and the finished segments' (u, p * n) summed by key."""

    def run(batches):
        zero = np.zeros(reps)
        state = None  # segment, whole, keys, p, n, u, and the open stretch: score, its p and n
        sums, out = {}, []

        def close_tie():
            state[5] += state[7] * (state[4] + state[8] / 2)
            state[3] += state[7]
            state[4] += state[8]

        def close_segment():
            close_tie()
            _, whole, keys, p, n, u = state[:6]
            if whole:
                both = sums.setdefault(keys, [zero.copy(), zero.copy()])
                both[0] += u
                both[1] += p * n
            else:
                out.append((*keys, state[0], p, n, u))

        def rows():
            cols = list(zip(*out)) if out else [[]] * (n_keys + 4)
            made = [pa.array(c, t) for c, t in zip(cols, kinds[:n_keys + 1])]
            made += [pa.array([list(v) for v in c], pa.list_(pa.float64())) for c in cols[n_keys + 1:]]
            out.clear()
            return pa.RecordBatch.from_arrays(made, names=names)

        names = kinds = None
        for batch in batches:
            if kinds is None:
                kinds = [*(batch.schema.field(2 + i).type for i in range(n_keys)), batch.schema.field(0).type]
                names = [*(f"k{i}" for i in range(n_keys)), "segment", "p", "n", "u"]
            for start in range(0, len(batch), ROWS_AT_ONCE):
                part = batch.slice(start, ROWS_AT_ONCE)
                segment = part.column(0).to_numpy(zero_copy_only=False)
                y, s = (part.column(i).to_numpy(zero_copy_only=False) for i in (2 + n_keys, 3 + n_keys))
                s = (np.where(np.isnan(s), np.nan, s) + 0.0).view(np.int64)  # equal scores are equal words, NaN among them
                w = _weights_of(part.column(4 + n_keys), reps).astype(float)
                first = np.flatnonzero(np.concatenate(([True], (segment[1:] != segment[:-1]) | (s[1:] != s[:-1]))))
                p = np.add.reduceat(w * y[:, None], first, axis=0)
                n = np.add.reduceat(w * (1 - y[:, None]), first, axis=0)
                tie_segment, tie_s = segment[first], s[first]
                cut = np.flatnonzero(np.concatenate(([True], tie_segment[1:] != tie_segment[:-1])))
                for a, b in zip(cut, [*cut[1:], len(first)]):
                    if state is None or state[0] != tie_segment[a]:
                        if state is not None:
                            close_segment()
                        at = int(first[a])
                        keys = tuple(part.column(2 + i)[at].as_py() for i in range(n_keys))
                        state = [tie_segment[a], part.column(1)[at].as_py(), keys, zero.copy(), zero.copy(), zero.copy(), tie_s[a], zero.copy(), zero.copy()]
                    if tie_s[a] == state[6]:
                        state[7] += p[a]
                        state[8] += n[a]
                        a += 1
                    if a < b:
                        close_tie()
                        before = state[4] + np.cumsum(n[a:b - 1], axis=0) - n[a:b - 1]
                        state[5] += (p[a:b - 1] * (before + n[a:b - 1] / 2)).sum(axis=0)
                        state[3] += p[a:b - 1].sum(axis=0)
                        state[4] += n[a:b - 1].sum(axis=0)
                        state[6], state[7], state[8] = tie_s[b - 1], p[b - 1].copy(), n[b - 1].copy()
            if len(out) > 100:
                yield rows()
        if state is not None:
            close_segment()
            out += [(*keys, None, u, d, None) for keys, (u, d) in sums.items()]
            cols = list(zip(*out))
            made = [pa.array(c, t) for c, t in zip(cols, kinds)]
            made += [pa.array([None if v is None else list(v) for v in c], pa.list_(pa.float64())) for c in cols[n_keys + 1:]]
            yield pa.RecordBatch.from_arrays(made, names=names)

    return run


def pairs_by_replicate(df: DataFrame, keys: list[str], group: list[str], reps: int, edges, parts: int) -> DataFrame:
    """keys, rep, num, den: concordant and all pairs of positives and negatives of one group, summed over groups.

    df: keys, group, y, s (doubles), h (hashes of Poisson draws, or packed weights).
    """
    df = df.withColumn("edges", edges)
    # even: between two edges; odd: on an edge, in as many parts as there are edges of that value
    df = df.withColumn("below", _count_below(F.col("edges"), F.col("s"), parts))
    on = F.coalesce(F.get("edges", F.col("below")) == F.col("s"), F.lit(False))
    same = F.when(on, F.size(F.filter("edges", lambda e: e == F.col("s")))).otherwise(F.lit(0))
    code = F.col("below") * 2 + on.cast("int")
    if group:
        size = df.groupBy(*keys, *group).agg((F.count(F.lit(1)) < LARGE_GROUP).alias("whole"))
        df = df.join(size, [*keys, *group])
    else:
        df = df.withColumn("whole", F.lit(False))
    df = df.withColumn("bucket", F.when(F.col("whole"), F.lit(-1)).otherwise(code))
    df = df.withColumn("part", F.when(~F.col("whole") & (same > 1), F.pmod(F.xxhash64("h"), same)).otherwise(F.lit(0)).cast("int"))
    name = F.to_json(F.struct(*keys, *group, F.col("bucket"), F.col("part")))
    rows = df.select(name.alias("segment"), "whole", *[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], "y", "s", "h")
    tall = rows.repartition(parts, "segment").sortWithinPartitions("segment", "s")
    kinds = ", ".join([*(f"k{i} {df.schema[k].dataType.simpleString()}" for i, k in enumerate(keys)), "segment string, p array<double>, n array<double>, u array<double>"])
    made = tall.mapInArrow(_streamed(reps, len(keys)), kinds)
    own = [f"k{i}" for i in range(len(keys))]

    def together(table: pa.Table) -> pa.Table:
        """One group's buckets in score order, the parts of a tie as one."""
        bucket = table["bucket"].to_numpy()
        p, n, u = (np.array(table[c].to_pylist(), float) for c in ("p", "n", "u"))
        order = np.argsort(bucket, kind="stable")
        first = np.flatnonzero(np.append(True, np.diff(bucket[order]) != 0))
        p, n, u = (np.add.reduceat(x[order], first, axis=0) for x in (p, n, u))
        tie = bucket[order][first] % 2 == 1
        u[tie] = p[tie] * n[tie] / 2
        before = np.cumsum(n, axis=0) - n
        return pa.table([*(table[k].slice(0, 1) for k in own), pa.array([list((u + p * before).sum(axis=0))], pa.list_(pa.float64())), pa.array([list(p.sum(axis=0) * n.sum(axis=0))], pa.list_(pa.float64()))], names=[*own, "num", "den"])

    whole = made.filter(F.col("segment").isNull()).select(*own, F.col("p").alias("num"), F.col("n").alias("den"))
    split = made.filter(F.col("segment").isNotNull()).select(
        "*", F.get_json_object("segment", "$.bucket").cast("int").alias("bucket"), F.regexp_replace("segment", r',?"bucket":-?\d+,"part":\d+\}$', "}").alias("g_"))
    back = ", ".join([*(f"k{i} {df.schema[k].dataType.simpleString()}" for i, k in enumerate(keys)), "num array<double>, den array<double>"])
    both = whole.unionByName(split.groupBy("g_").applyInArrow(together, back))
    each = both.select(*own, F.posexplode(F.arrays_zip("num", "den")).alias("rep", "c")).select(*own, (F.col("rep") + 1).alias("rep"), "c.num", "c.den")
    return each.groupBy(*own, "rep").agg(F.sum("num").alias("num"), F.sum("den").alias("den")).withColumnsRenamed({f"k{i}": k for i, k in enumerate(keys)})


def decompose_replicates(df: DataFrame, keys: list[str], g: str, ids: list[str], reps: int, seed: int, y: str = "y", s: str = "score") -> DataFrame:
    """keys, rep, tt (total, within, between), auc of Poisson bootstrap replicates. Rows without a 0/1 label or with a NULL
    key, group or score are left out; ``ids`` must name a row."""
    base = df.filter(F.col(y).isin(0, 1) & F.col(s).isNotNull()).dropna(subset=[*keys, g])
    return _parts_by_replicate(base.select(*keys, g, F.col(y).cast("double").alias("y"), F.col(s).cast("double").alias("s"),
                                           draw_bits(seed, "b", *[F.col(c) for c in ids]).alias("h")), keys, g, reps)


def decompose_exact(df: DataFrame, keys: list[str], g: str, order: list[str], reps: int, seed: int, y: str = "y", s: str = "score") -> DataFrame:
    """As ``decompose_replicates``, of replicates with exactly as many draws as rows in each class; rows without a group
    count for the total."""
    return _parts_by_replicate(_weighted(df.select(*dict.fromkeys([*keys, g, y, *order, s])), [*keys, y], order, reps, seed, [*keys, g], y, {"": s}), keys, g, reps)


def auc_exact(df: DataFrame, keys: list[str], scores: dict[str, str], order: list[str], reps: int, seed: int, y: str = "y") -> DataFrame:
    """keys, which, rep, auc of several scores on the same draws within keys (not by class); ``scores``: {which: column}."""
    base = cut_lineage(_weighted(df.select(*dict.fromkeys([*keys, y, *order, *scores.values()])), keys, order, reps, seed, keys, y, scores))
    edges, parts = _cut(base)
    found = pairs_by_replicate(base, [*keys, "which"], [], reps, edges, parts)
    return found.select(*keys, "which", "rep", div(F.col("num"), F.col("den")).alias("auc"))


def _weighted(df: DataFrame, strata: list[str], order: list[str], reps: int, seed: int, own: list[str], y: str, scores: dict[str, str]) -> DataFrame:
    """own, (which,) y, s, h of exact draws: the rows with a 0/1 label, once for each score they have."""
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in own), "_y double", *(f"_s{i} double" for i in range(len(scores))), "h binary"])
    df = df.withColumns({"_y": F.col(y).cast("double"), **{f"_s{i}": F.col(s).cast("double") for i, s in enumerate(scores.values())}})
    names = [*own, "_y", *(f"_s{i}" for i in range(len(scores)))]
    rows = with_weights(df, strata, order, reps, seed, lambda t, w: t.select(names).append_column("h", pack_weights(w)), schema)
    rows = rows.filter(F.col("_y").isin(0.0, 1.0))
    if len(scores) == 1:
        return rows.select(*own, F.col("_y").alias("y"), F.col("_s0").alias("s"), "h").filter(F.col("s").isNotNull())
    each = F.array(*[F.struct(F.lit(k).alias("which"), F.col(f"_s{i}").alias("s")) for i, k in enumerate(scores)])
    return rows.select(*own, F.col("_y").alias("y"), "h", F.inline(each)).filter(F.col("s").isNotNull())


def _cut(base: DataFrame) -> tuple:
    """Edges of the scores as a scalar subquery, and the number of tasks."""
    parts = max(default_buckets(base), base.sparkSession.sparkContext.defaultParallelism)
    cut = [i / parts for i in range(1, parts)] or [0.5]
    return base.select(F.array_sort(F.percentile_approx("s", cut, 1000))).scalar(), parts


def _parts_by_replicate(base: DataFrame, keys: list[str], g: str, reps: int) -> DataFrame:
    """keys, rep, tt, auc from keys, g, y, s, h."""
    base = cut_lineage(base)
    edges, parts = _cut(base)
    total = pairs_by_replicate(base.drop(g), keys, [], reps, edges, parts)
    within = pairs_by_replicate(base.dropna(subset=[g]), keys, [g], reps, edges, parts).withColumnsRenamed({"num": "num_w", "den": "den_w"})
    both = total.join(within, [*keys, "rep"])
    tall = F.array(F.struct(F.lit("total").alias("tt"), F.col("num"), F.col("den")),
                   F.struct(F.lit("within").alias("tt"), F.col("num_w").alias("num"), F.col("den_w").alias("den")),
                   F.struct(F.lit("between").alias("tt"), (F.col("num") - F.col("num_w")).alias("num"), (F.col("den") - F.col("den_w")).alias("den")))
    return both.select(*keys, "rep", F.inline(tall)).select(*keys, "rep", "tt", div(F.col("num"), F.col("den")).alias("auc"))
