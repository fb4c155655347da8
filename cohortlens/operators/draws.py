"""Draw numbers by key (C12, I2, I8, K11, L15): any number of draws from a key, spread over tasks.

A table of sizes becomes one row for each chunk of a key's draws; chunks are dealt out by hash and only then opened, so a key
with 1e8 draws is a thousand pieces of work. A draw is a function of (seed, key, number), so it does not depend on how the
pieces lie.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .ordered import default_buckets

#: Draws that one row is opened to.
CHUNK = 100_000


def spread_draws(sizes: DataFrame, keys: list[str], n: Column | int, out: str = "i", chunk: int | None = None) -> DataFrame:
    """All columns of ``sizes`` and ``out`` = 1 .. n for each row (n may differ by row; 0 or NULL gives none)."""
    chunk = chunk or CHUNK
    count = (n if isinstance(n, Column) else F.lit(n)).cast("bigint")
    firsts = F.when(count > 0, F.sequence(F.lit(1).cast("bigint"), count, F.lit(chunk).cast("bigint")))
    opened = sizes.withColumn("_first", F.explode(firsts)).withColumn("_last", F.least(F.col("_first") + (chunk - 1), count))
    tasks = max(default_buckets(sizes), sizes.sparkSession.sparkContext.defaultParallelism)
    dealt = opened.repartition(tasks, *[F.col(f"`{k}`") for k in keys], "_first")
    return dealt.withColumn(out, F.explode(F.sequence("_first", "_last"))).drop("_first", "_last")
