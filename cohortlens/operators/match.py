"""Record matching (section 2.N)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import levenshtein_ratio
from .nearest import nearest
from .sets import duplicates


def duplicate_pairs(df: DataFrame, ignore: list[str]) -> DataFrame:
    """Rows that repeat another row's content, and their number in pairs: rows, pairs."""
    return duplicates(df, ignore).agg(F.count(F.lit(1)).alias("rows"), F.floor(F.count(F.lit(1)) / 2).alias("pairs"))


def nearest_match(queries: DataFrame, reference: DataFrame, num_cols: list[str], cat_cols: list[str],
                  qid: str, rid: str) -> DataFrame:
    """Nearest reference row by summed absolute difference with the share of equal categories."""
    return nearest(queries, reference, num_cols, cat_cols, qid, rid)


def suspects(matches: DataFrame, share: float = 0.95, dist: float = 2.0) -> DataFrame:
    """Matches close enough to be the same person."""
    return matches.filter((F.col("prop") > share) & (F.col("err") < dist))


def similar_pairs(df: DataFrame, col: str, ratio: float) -> DataFrame:
    """All pairs a < b of distinct values with levenshtein_ratio >= ratio (in (0, 1)): a, b, ratio.

    Exact, without listing all pairs: k edits leave one of k + 1 pieces of the longer text as it was, at most k places
    away. So each text lists its own k + 1 pieces as the longer one, and, for every length that its partner may have, the
    stretches that could be such a piece; pairs meet on (length, piece number, stretch) only. NULL meets nothing.
    """
    words = df.select(F.col(col).alias("a")).filter(F.col(col).isNotNull()).distinct().withColumn("n", F.length("a"))
    at_least = ratio - 1e-9
    k = F.floor((1 - at_least) * F.col("m")).cast("int")  # edits that a longer length of m allows
    start = F.floor(F.col("i") * F.col("m") / (F.col("k") + 1)).cast("int")
    width = F.floor((F.col("i") + 1) * F.col("m") / (F.col("k") + 1)).cast("int") - start

    def pieces(d: DataFrame) -> DataFrame:
        return (d.withColumn("k", k).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("k"))))
                .withColumn("p", start).withColumn("w", width))

    own = pieces(words.filter("n > 0").withColumn("m", F.col("n"))).select(
        F.col("a").alias("b"), "m", "i", F.substring("a", F.col("p") + 1, F.col("w")).alias("s"))
    lengths = F.sequence(F.col("n"), F.floor(F.col("n") / at_least).cast("int"))
    near = F.sequence(F.greatest(F.lit(0), F.col("p") - F.col("k")), F.least(F.col("p") + F.col("k"), F.col("n") - F.col("w")))
    other = pieces(words.filter("n > 0").withColumn("m", F.explode(lengths))).filter(
        F.greatest(F.lit(0), F.col("p") - F.col("k")) <= F.least(F.col("p") + F.col("k"), F.col("n") - F.col("w")))
    other = other.withColumn("q", F.explode(near)).select("a", "m", "i", F.substring("a", F.col("q") + 1, F.col("w")).alias("s"))
    met = other.join(own, ["m", "i", "s"]).filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return met.withColumn("ratio", levenshtein_ratio(F.col("a"), F.col("b"))).filter(F.col("ratio") >= at_least)


def side_by_side(found: DataFrame, queries: DataFrame, reference: DataFrame, qid: str, rid: str,
                 cols: list[str]) -> DataFrame:
    """Both sides of each suspect pair, one row per column: qid, rid, column_name, query, reference."""
    q = queries.select(qid, *[F.col(c).cast("string").alias(f"_q_{c}") for c in cols])
    r = reference.select(rid, *[F.col(c).cast("string").alias(f"_r_{c}") for c in cols])
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"_q_{c}").alias("query"),
                               F.col(f"_r_{c}").alias("reference")) for c in cols])
    return found.join(q, qid).join(r, rid).select(qid, rid, F.explode(cells).alias("_c")).select(qid, rid, "_c.*")
