"""Merkle manifest of a table: leaves, subroots by source, one root, and a proof for each row.

Slot pivot: the nodes of a level are numbered within their tree; node i is child i % 16 of parent i // 16. One grouping by
parent spreads the children into 16 slot columns by conditional aggregates. The columns joined and hashed are the parent;
the columns before and after a slot are the siblings of the child in it. So a level is one shuffle of its nodes, and proofs
come from the same rows on the way down: every pivot row meets the path of the node that it makes and hands it to its
children, with their siblings in front. Texts are read and hashed once; what is shuffled is digests.

DataFrame functions only. Numbering is a bucketed scan, so a source with a third of all rows is many tasks' work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.ordered import number_rows, scan
from .common import written

FANOUT = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SLOTS = [f"c{s}" for s in range(FANOUT)]


def field(value: Column) -> Column:
    """'-' for null, else the length in bytes, ':' and the value as text."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_hash(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(c) for c in columns]), 256)


def _digest(slots: list[Column]) -> Column:
    return F.sha2(F.concat(F.lit(""), *[F.coalesce(s, F.lit("")) for s in slots]), 256)


def _siblings(slots: list[Column], own: int) -> Column:
    """(left, right): what stands before and after a child in its parent's input."""
    side = [F.concat(F.lit(""), *[F.coalesce(s, F.lit("")) for s in part]) for part in (slots[:own], slots[own + 1:])]
    return F.struct(side[0].alias("left"), side[1].alias("right"))


def _pivoted(nodes: DataFrame, value: Column, name: str) -> DataFrame:
    """(tree, at, n, c0 ... c15): a row for each parent of nodes (tree, i, n, ...); n: how many nodes the tree has there."""
    slot = F.col("i") % FANOUT
    wide = [F.max(F.when(slot == s, value)).alias(SLOTS[s]) for s in range(FANOUT)]
    return written(nodes.groupBy("tree", (F.col("i") / FANOUT).cast("bigint").alias("at")).agg(F.max("n").alias("n"), *wide), name)


def _made(level: DataFrame, slots: list[Column]) -> DataFrame:
    """(tree, i, n, h): the nodes that pivot rows make; a lone node is handed on as it is."""
    h = F.when(F.col("n") == 1, slots[0]).otherwise(_digest(slots))
    return level.select("tree", F.col("at").alias("i"), F.ceil(F.col("n") / FANOUT).cast("bigint").alias("n"), h.alias("h"))


def _climb(level: DataFrame, slots: list[Column], most: int, name: str) -> tuple[list[DataFrame], DataFrame]:
    """(pivots above ``level``, lowest first; (tree, h, height): the roots). most: nodes of the largest tree in ``level``.

    height: how many of the levels, ``level`` included, a tree has.
    """
    nodes, levels, tops = _made(level, slots), [], None
    while True:
        done = nodes.where("n = 1").select("tree", "h", F.lit(len(levels) + 1).alias("height"))
        tops = done if tops is None else tops.unionByName(done)
        most = -(-most // FANOUT)
        if most <= 1:
            return levels, tops
        up = _pivoted(nodes.where("n > 1"), F.col("h"), f"{name}-{len(levels) + 1}")
        levels.append(up)
        nodes = _made(up, [F.col(c) for c in SLOTS])


def _handed_down(pivot: DataFrame, paths: DataFrame, slots: list[Column]) -> DataFrame:
    """(tree, i, path, child, subroot): the children of pivot rows with their paths; ``paths`` has those of the nodes the rows make."""
    out = []
    for s in range(FANOUT):
        own = F.concat(F.array(_siblings(slots, s)), F.col("path"))
        path = F.when(F.col("n") == 1, F.col("path")).otherwise(own)
        out.append(F.when(F.col(SLOTS[s]).isNotNull(), F.struct((F.col("at") * FANOUT + s).alias("i"), path.alias("path"), F.col(SLOTS[s]).alias("child"))))
    met = pivot.join(paths.withColumnRenamed("i", "at"), ["tree", "at"])
    return met.select("tree", "subroot", F.explode(F.array(*out)).alias("x")).where("x is not null").select("tree", "subroot", "x.*")


def _descend(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """(tree, i, path, subroot) of the nodes made by the level below ``levels``; tops: (tree, height, path, subroot) of the roots."""
    slots = [F.col(c) for c in SLOTS]
    paths = None
    for k in range(len(levels), -1, -1):
        here = tops.where(F.col("height") == k + 1).select("tree", F.lit(0).cast("bigint").alias("i"), "path", "subroot")
        if paths is not None:
            here = here.unionByName(_handed_down(levels[k], paths, slots).drop("child"))
        paths = here
    return paths


def manifest(docs: DataFrame, id: str = "doc_id", source: str = "source", columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
             text: str = "text") -> DataFrame:
    """Per row: id, leaf, subroot, root, path (array of (left, right) sibling digests, leaf to root), tampered_leaf. Runs jobs.

    A leaf is the digest of ``columns``, each '-' if null, else length, ':' and value. Within a source leaves ascend by id,
    null ids first, equal ids by leaf. Every 16 consecutive nodes, the last run fewer, make one until one is left, the subroot
    (a lone leaf itself); subroots ordered by source (null first, bytewise) make the root likewise. tampered_leaf is the leaf
    with A-Z of the text lower-cased where 5 divides the crc32 of the decimal id, else null (null ids too).

    Every row of repeated rows is a leaf; an empty table gives no rows; texts are hashed whole, whatever their length, and other
    columns are not read, so their names may clash. Source may be any type that casts to text.
    """
    where = {k: docs[f"`{k}`"] for k in {id, source, text, *columns}}
    rows = docs.select(
        where[id].alias("id"), F.concat(F.lit("1"), where[source].cast("string")).alias("tree"),
        leaf_hash([where[c] for c in columns]).alias("leaf"),
        F.when(F.crc32(where[id].cast("string").cast("binary")) % 5 == 0,
               leaf_hash([F.translate(where[c], UPPER, LOWER) if c == text else where[c] for c in columns])).alias("tampered"))
    # the tie makes equal rows distinct; written, it stays the same for all that follows
    kind = docs.schema[id].dataType.simpleString()
    leaves = written(rows.select(F.coalesce("tree", F.lit("0")).alias("tree"), "id", F.col("id").isNotNull().cast("int").alias("known"),
                                 F.coalesce("id", F.lit("0").cast(kind)).alias("by"), "leaf", "tampered", F.monotonically_increasing_id().alias("tie")), "leaves")
    order = ["known", "by", "leaf", "tie"]
    numbered = scan(leaves.withColumn("one", F.lit(1)), ["tree"], order, {"rn": ("count", None)}, totals={"n": "one"})
    child = F.struct(F.col("leaf").alias("h"), "id", "tampered")
    bottom = _pivoted(numbered.select("tree", (F.col("rn") - 1).alias("i"), "n", "leaf", "id", "tampered"), child, "merkle-0")
    below = [F.col(c)["h"] for c in SLOTS]
    levels, tops = _climb(bottom, below, bottom.agg(F.max("n")).first()[0] or 0, "merkle")
    # the tree over the subroots is built alike
    tops = written(tops, "subroots")
    ranked = number_rows(tops.withColumn("whole", F.lit("all")), ["whole"], ["tree"])
    count = tops.count()
    upper = _pivoted(ranked.select(F.col("whole").alias("tree"), (F.col("rn") - 1).alias("i"), F.lit(count).cast("bigint").alias("n"),
                                   F.struct("h", F.col("tree").alias("of"), "height").alias("child")), F.col("child"), "merkle-top")
    upper_levels, crown = _climb(upper, below, count, "merkle-top")
    top = crown.first()
    root = F.lit(top["h"] if top else None).cast("string")
    step = "array<struct<left: string, right: string>>"
    paths = _descend(upper_levels, crown.select("tree", "height", F.array().cast(step).alias("path"), F.lit(None).cast("string").alias("subroot")))
    above = _handed_down(upper, paths, below)
    above = written(above.select(F.col("child.of").alias("tree"), F.col("child.height").alias("height"), F.col("child.h").alias("subroot"), "path"), "subroot-paths")
    found = _handed_down(bottom, _descend(levels, above), below)
    return found.select(F.col("child.id").alias(id), F.col("child.h").alias("leaf"), "subroot", root.alias("root"), "path", F.col("child.tampered").alias("tampered_leaf"))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda h, x: F.sha2(F.concat(x["left"], h, x["right"]), 256))


def verified(made: DataFrame) -> DataFrame:
    """From manifest(): path replaced by proof_sha256 (of all siblings one after the other), and the tampered leaf by folded_root (from it where there is
    one, else from the leaf) and verified (it is the root)."""
    proof = F.sha2(F.array_join(F.transform("path", lambda x: F.concat(x["left"], x["right"])), ""), 256)
    keep = [c for c in made.columns if c not in ("path", "tampered_leaf")]
    out = made.select(*keep, proof.alias("proof_sha256"), folded(F.coalesce("tampered_leaf", "leaf"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
