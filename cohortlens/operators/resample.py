"""Resampling with replacement as joins.

Row i of a stratum of n rows makes one draw per replicate: position h(seed, stratum, replicate, i) mod n,
where h is a stateless hash. Draws are counted to multiplicities before they meet the rows, so rows are
never copied, replicates have exactly n draws, and a recomputed task draws the same.
"""

from __future__ import annotations

from collections.abc import Callable
from math import exp, factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.draws import draw_uniform
from ..functions.hashed import hashed
from ..session import cut_lineage
from .ordered import default_buckets, scan

#: Draws that a task makes at once; weights (rows x replicates) that are counted in one place.
DRAWS_AT_ONCE, WEIGHTS_AT_ONCE = 250_000, 2_000_000


def numbered(df: DataFrame, strata: list[str], order: list[str]) -> DataFrame:
    """Rows with their position _idx (1..) and the size _n of their stratum."""
    one = df.withColumn("_one", F.lit(1).cast("bigint"))
    return scan(one, strata, order, {"_idx": ("count", None)}, totals={"_n": "_one"}).drop("_one")


def _positions(seed: int, kind: str, key: str, lane: tuple, of: np.ndarray, n: int) -> np.ndarray:
    """Draws h(seed, kind, key, lane, i) mod n for the numbers i, as functions.draws.draw_index makes them."""
    lead = ":".join(str(v) for v in (seed, kind, key, *lane, "")).encode()
    return hashed(lead, of).astype(np.int64) % n


def _block_rows(lanes: int) -> int:
    """Positions of a stratum whose weights are counted in one place."""
    return max(WEIGHTS_AT_ONCE // lanes, 1)


def _packed_draws(rows: DataFrame, strata: list[str], reps: int, seed: int, subreps: int = 0) -> DataFrame:
    """strata, _block, _cells: the draws of a range of positions, for a replicate and its subs, that fall into a block of
    target positions, four bytes each."""
    subs = subreps + 1
    lanes = reps * subs
    chunk, block = max(DRAWS_AT_ONCE // subs, 1), _block_rows(lanes)
    sizes = rows.groupBy(*strata).agg(F.max("_n").cast("bigint").alias("_n"))
    starts = F.sequence(F.lit(1).cast("bigint"), F.col("_n"), F.lit(chunk).cast("bigint"))
    text = F.concat_ws(":", *[F.col(c).cast("string") for c in strata])
    work = sizes.select(*strata, text.alias("_text"), "_n", F.explode(starts).alias("_first"))
    work = work.select("*", F.explode(F.sequence(F.lit(1), F.lit(reps))).alias("_rep"))
    tasks = max(default_buckets(rows), rows.sparkSession.sparkContext.defaultParallelism)
    work = work.repartition(tasks, *strata, "_first", "_rep")
    keys = range(len(strata))

    def drawn(batches):
        for batch in batches:
            for row in range(len(batch)):
                key, n, first, rep = (batch.column(len(strata) + i)[row].as_py() for i in range(4))
                own = np.arange(first, min(first + chunk, n + 1))
                parts = []
                for sub in range(subs):
                    at = own if sub == 0 else _positions(seed, "s", key, (rep, sub), own, n) + 1
                    parts.append(_positions(seed, "r", key, (rep,), at, n) * lanes + ((rep - 1) * subs + sub))
                cells = np.sort(np.concatenate(parts))
                cuts = np.flatnonzero(np.diff(cells // (block * lanes), prepend=-1))
                found = [(int(c[0] // (block * lanes)), c) for c in np.split(cells, cuts[1:])]
                packed = [(c - b * block * lanes).astype("<u4").tobytes() for b, c in found]
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array([batch.column(i)[row].as_py()] * len(found), batch.schema.field(i).type) for i in keys),
                     pa.array([b for b, _ in found], pa.int64()), pa.array(packed, pa.binary())], names=[*strata, "_block", "_cells"])

    return work.mapInArrow(drawn, f"{_kinds(rows, strata)}, _block bigint, _cells binary")


def _kinds(rows: DataFrame, cols: list[str]) -> str:
    return ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in cols)


def _counts(cells: pa.ChunkedArray, block: int, lanes: int) -> np.ndarray:
    """(positions of the block, lanes) from its packed draws."""
    drawn = np.frombuffer(b"".join(cells.to_pylist()), "<u4")
    return np.bincount(drawn, minlength=block * lanes).astype(np.int32).reshape(block, lanes)


def draw_weights(rows: DataFrame, strata: list[str], reps: int, seed: int, subreps: int = 0) -> DataFrame:
    """strata, _idx, _w: times that each replicate draws the row, in the order of (rep, sub); rows never drawn are left out.

    sub 0 is the replicate itself; sub 1.. resample the replicate. Draws need the sizes of strata only. A task draws for a
    range of positions and packs what it drew by blocks of target positions, four bytes a draw; a block is then counted in
    one place, whose size does not grow with the stratum.
    """
    lanes = reps * (subreps + 1)
    block, kinds = _block_rows(lanes), _kinds(rows, strata)
    packed = _packed_draws(rows, strata, reps, seed, subreps)

    def counted(table: pa.Table) -> pa.Table:
        w = _counts(table["_cells"], block, lanes)
        at = np.flatnonzero(w.any(axis=1))
        ends = pa.array(np.arange(0, (len(at) + 1) * lanes, lanes, dtype=np.int32))
        idx = pa.array(at + table["_block"][0].as_py() * block + 1, pa.int64())
        own = [pa.array([table[c][0].as_py()] * len(at), table.schema.field(c).type) for c in strata]
        return pa.table([*own, idx, pa.ListArray.from_arrays(ends, pa.array(w[at].ravel()))], names=[*strata, "_idx", "_w"])

    return packed.groupBy(*strata, "_block").applyInArrow(counted, f"{kinds}, _idx bigint, _w array<int>")


def resample(df: DataFrame, strata: list[str], order: list[str], reps: int, seed: int,
             subreps: int = 0) -> DataFrame:
    """Rows with their multiplicity: all columns, rep, (sub,) weight.

    ``order`` must make rows distinct within a stratum (or tied rows interchangeable). Strata must be
    integers or text. The numbered rows are checkpointed (an action), as draws and join both read them. A row meets its
    weights once and is opened to replicates after that; neither side, as long as the table, goes through the driver.
    """
    rows = cut_lineage(numbered(df, strata, order))
    weights = draw_weights(rows, strata, reps, seed, subreps)
    both = rows.join(weights.hint("merge"), on=[*strata, "_idx"]).drop("_idx", "_n")
    kept = [c for c in both.columns if c != "_w"]
    out = both.select(*kept, F.posexplode("_w").alias("_lane", "weight")).filter("weight > 0")
    rep, sub = F.floor(F.col("_lane") / (subreps + 1)) + 1, F.col("_lane") % (subreps + 1)
    return out.select(*kept, rep.cast("int").alias("rep"), *([sub.alias("sub")] if subreps else []), F.col("weight").cast("bigint").alias("weight"))


def with_weights(df: DataFrame, strata: list[str], order: list[str], reps: int, seed: int, make: Callable[[pa.Table, np.ndarray], pa.Table],
                 schema: str, subreps: int = 0) -> DataFrame:
    """``make(rows, weights)`` over blocks of a stratum's rows, with their draws as (rows, lanes) in the order of (rep, sub).

    As ``resample``, for what works on all replicates of a row at once: rows and draws meet by block, and no row is opened to
    replicates. ``rows`` has the columns of ``df``; rows never drawn are among them, with weights 0.
    """
    rows = cut_lineage(numbered(df, strata, order))
    lanes = reps * (subreps + 1)
    block = _block_rows(lanes)
    packed = _packed_draws(rows, strata, reps, seed, subreps)
    names = df.columns

    def met(own: pa.Table, drawn: pa.Table) -> pa.Table:
        w = _counts(drawn["_cells"], block, lanes)
        at = (own["_idx"].to_numpy() - 1) % block
        return make(own.select(names), w[at])

    blocked = rows.drop("_n").withColumn("_block", F.floor((F.col("_idx") - 1) / block).cast("bigint"))
    return blocked.groupBy(*strata, "_block").cogroup(packed.groupBy(*strata, "_block")).applyInArrow(met, schema)


# Cumulative Poisson(1) probabilities.
POISSON_STEPS = [sum(exp(-1) / factorial(i) for i in range(k + 1)) for k in range(12)]


def resample_poisson(df: DataFrame, ids: list[str], reps: int, seed: int) -> DataFrame:
    """Bulk alternative without a join: independent Poisson(1) multiplicities by row id.

    Replicate sizes vary around n; use where n is large and the exact size does not matter.
    """
    # the fan-out starts from all cores; a draw is a generated value, so it is hashed once and not again for each step
    tasks = max(default_buckets(df), df.sparkSession.sparkContext.defaultParallelism)
    draws = F.array(*[F.struct(F.lit(rep).alias("rep"), draw_uniform(seed, "p", *[F.col(c) for c in ids], F.lit(rep)).alias("_u")) for rep in range(1, reps + 1)])
    weight = sum(((F.col("_u") >= F.lit(step)).cast("bigint") for step in POISSON_STEPS), F.lit(0).cast("bigint"))
    return (df.repartition(tasks, *ids).select("*", F.inline(draws)).withColumn("weight", weight).drop("_u").filter(F.col("weight") > 0))
