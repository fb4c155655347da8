"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard checks.

A text's set holds its distinct n-word shingles (A-Z lower-cased, words split at ASCII white space; a text of fewer words
is one shingle; no words: empty, linked with nothing). Texts are linked when 100 * |a & b| >= threshold * |a | b|, and the
answer is each document's connected component.

* Signatures: permutation sigma spreads the shingles over D cells, permutation pi gives the cells their ranks; coordinate
  k is the least rank after shifting pi circularly by k, so K coordinates are the elementwise least of K consecutive ranks
  read at each shingle's cell, and two permutations replace K hash functions.
* Equal sets are met first, by size and a 128-bit digest; only one document of each goes on.
* A pair at or above the threshold misses all bands with probability (1 - 0.8**ROWS)**BANDS < 5e-7.
* Pairs of a bucket are not listed. Its smallest document is checked against each of the others; links join components,
  and later a bucket is looked at only where it still holds several components. There its least edited document is
  checked likewise, and what is then still open goes through an exact prefix join of full sets: pairs are met on rare
  early shingles only, and only across components, so copies with many edits of their own cost nothing and no link
  between different components is lost.
* Checks compare full sets made from the texts of the two documents. Components come from alternating rounds of hooking
  to the smallest neighbour and pointer jumping, each written to the shared folder.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from .common import per_text, text_words, written

ROWS, BANDS = 6, 48
CELLS = 1 << 20
#: Shingles whose rank windows are held at once.
BLOCK = 4096
#: Bytes of text whose shingles are held at once; each takes some 30 bytes.
SLICE = 2 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Bijection of 64-bit integers that spreads them (finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(2)
def rank_windows(k: int) -> np.ndarray:
    """(CELLS, k) view: the ranks that pi gives a cell after 0 to k - 1 circular shifts."""
    pi = np.random.default_rng(20_011).permutation(CELLS).astype(np.int32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate((pi, pi[:k - 1])), k)


def distinct_shingles(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, 64-bit hash) of the distinct shingles of each text, by text; distinctness is exact."""
    words, per = text_words(texts, lower=True)
    coded = words.dictionary_encode()
    ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w.as_buffer()) for w in coded.dictionary), np.uint64, len(coded.dictionary))
    owner = np.repeat(np.arange(len(per)), per)
    left = np.repeat(np.cumsum(per), per) - np.arange(len(ids))  # words from here to the end of the text
    full, short = np.flatnonzero(left >= n), np.flatnonzero((per < n) & (per > 0))
    code = ids.copy()
    value = mix(hashes)[ids] if len(ids) else np.zeros(0, np.uint64)
    pick = [(full, n), *((np.cumsum(per)[short[per[short] == m]] - m, m) for m in range(1, n))]
    docs, codes, values = [], [], []
    for at, length in pick:
        if not len(at):
            continue
        c, v = code[at], value[at] + np.uint64(length)
        for j in range(1, length):
            if j > 1:  # numbered anew, so that the code stays below 2**62
                c = np.unique(c, return_inverse=True)[1]
            c = c * np.int64(len(hashes)) + ids[at + j]
            v = mix(v * np.uint64(0x9E3779B97F4A7C15) + value[at + j])
        docs.append(owner[at])
        codes.append(c)
        values.append(v)
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    kept = []
    for d, c in zip(docs, codes):
        top = int(c.max()) + 1
        if (int(d.max()) + 1) * top < 1 << 63:
            kept.append(np.unique(d * top + c, return_index=True)[1])
        else:
            kept.append(np.unique(np.stack((d, c), 1), axis=0, return_index=True)[1])
    d = np.concatenate([d[k] for d, k in zip(docs, kept)])
    v = np.concatenate([v[k] for v, k in zip(values, kept)])
    order = np.argsort(d, kind="stable")
    return d[order], v[order]


def signature(cells: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Circulant MinHash coordinates of one set given its cells."""
    out = windows[cells[:BLOCK]].min(axis=0)
    for a in range(BLOCK, len(cells), BLOCK):
        np.minimum(out, windows[cells[a:a + BLOCK]].min(axis=0), out=out)
    return out


def describe(texts: pa.Array, n: int) -> dict[str, pa.Array]:
    """Size, digest and band keys (null: empty set) of each text's shingle set."""
    owner, values = distinct_shingles(texts, n)
    size = np.bincount(owner, minlength=len(texts))
    ends = np.cumsum(size)
    digests = []
    for salt in (0x1B873593CC9E2D51, 0x2545F4914F6CDD1D):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(values ^ np.uint64(salt)))))
        digests.append((sums[ends] - sums[ends - size]).view(np.int64))
    windows = rank_windows(ROWS * BANDS)
    cells = (mix(values + np.uint64(0x51ED27F5)) & np.uint64(CELLS - 1)).astype(np.int64)
    rows = np.flatnonzero(size)
    signs = np.empty((len(rows), ROWS * BANDS), np.int32)
    for i, r in enumerate(rows):
        signs[i] = signature(cells[ends[r] - size[r]:ends[r]], windows)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    for j in range(ROWS):
        keys = mix(keys + signs[:, j::ROWS].astype(np.uint64))
    counts = np.where(size > 0, BANDS, 0)
    bands = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.array(keys.ravel().view(np.int64)))
    return {"n": pa.array(size.astype(np.int64)), "d1": pa.array(digests[0]), "d2": pa.array(digests[1]), "bands": bands}


# --- links ----------------------------------------------------------------------------------------

def shingle_set(text: str | None, n: int) -> set:
    """The full set of a text; exact, no hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return set(zip(*(words[i:] for i in range(n)))) if len(words) >= n else {tuple(words)} if words else set()


def verified(pairs: DataFrame, texts: DataFrame, n: int, threshold: int) -> DataFrame:
    """Those pairs (a, b) of ids whose full sets reach the threshold. texts: (id, text), only documents that are in pairs matter."""

    def check(batches):
        last, left = None, set()
        for batch in batches:
            a, ta, b, tb = (batch.column(i) for i in range(4))
            good = []
            for i in range(len(batch)):
                key = (a[i].as_py(), ta[i].as_py())
                if key != last:
                    last, left = key, shingle_set(key[1], n)
                right = shingle_set(tb[i].as_py(), n)
                both = len(left & right)
                if both and 100 * both >= threshold * (len(left) + len(right) - both):
                    good.append(i)
            yield batch.select(["a", "b"]).take(pa.array(good, pa.int64()))

    of = lambda side: texts.select(F.col("id").alias(side), F.col("text").alias("t" + side))
    both = pairs.join(of("b"), "b").join(of("a"), "a").select("a", "ta", "b", "tb")
    return both.mapInArrow(check, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): smallest node that each node of the edges (a, b) reaches. Runs a few jobs.

    Each round hooks every node's label to the smallest label beside it and then follows labels of labels; it ends when
    nothing changes.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges")
    label = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), "labels")
    while True:
        near = both.join(label.withColumnRenamed("node", "b"), "b").select(F.col("a").alias("node"), "comp")
        # a smaller label of a neighbour is also one for the node the old label names
        old = label.select("node", F.col("comp").alias("old"))
        least = near.groupBy("node").agg(F.min("comp").alias("seen")).join(old, "node").select(
            "node", "old", F.least("seen", "old").alias("comp"))
        roots = least.groupBy(F.col("old").alias("node")).agg(F.min("comp").alias("root"))
        hooked = least.join(roots, "node", "left").select(
            "node", "old", F.least("comp", F.coalesce("root", "comp")).alias("comp"))
        hooked = written(hooked, "hooked")
        far = hooked.select(F.col("node").alias("comp"), F.col("comp").alias("far"))
        jumped = hooked.join(far, "comp", "left").select("node", "old", F.least("comp", F.coalesce("far", "comp")).alias("comp"))
        label = written(jumped, "labels")
        if label.where("comp <> old").isEmpty():
            return label.select("node", "comp")
        label = label.select("node", "comp")


def _new_labels(label: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (id, comp) after more links between ids: contracted to components first."""
    left, right = (label.select(F.col("id").alias(s), F.col("comp").alias("c" + s)) for s in ("a", "b"))
    edges = links.join(left, "a").join(right, "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")).where("a <> b")
    found = components(edges).select(F.col("node").alias("comp"), F.col("comp").alias("to"))
    return written(label.join(found, "comp", "left").select("id", F.coalesce("to", "comp").alias("comp")), "components")


def _shared_shingles(texts: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """(id, h, df): the shingles of the named texts that at least two of them have, with how many have them."""

    def hashes(batches):
        for batch in batches:
            owner, values = distinct_shingles(batch.column(1).cast(pa.large_string()).fill_null(""), n)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), pa.array(values.view(np.int64))], names=["id", "h"])

    rows = texts.join(ids, "id", "left_semi").select("id", "text").mapInArrow(hashes, "id bigint, h bigint").distinct()
    often = rows.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    return rows.join(often, "h").select("id", "h", "df")


def _prefix_pairs(shared: DataFrame, docs: DataFrame, threshold: int) -> DataFrame:
    """(a, b): pairs of documents of different components that may reach the threshold. docs: (id, n, u, comp).

    Shingles are ordered from rare to frequent (those of one document only come first). Two linked sets have their first
    common shingle early in both, and after it at least as many shingles as their intersection needs: pairs are met on
    such shingles only, and where both places leave room. Sets that differ by their own rare shingles never meet.
    """
    t = threshold
    place = (F.col("n") - F.col("u") - 1 + F.row_number().over(Window.partitionBy("id").orderBy("df", "h"))).alias("at")
    early = shared.join(docs, "id").select("id", "h", "n", "comp", place).where(f"at <= n - ceil({t} * n / 100)")
    x, y = early.alias("x"), early.alias("y")
    short = f"(x.n < y.n or x.n = y.n and x.id < y.id) and x.at <= x.n - ceil({2 * t} * x.n / {100 + t}) and 100 * x.n >= {t} * y.n"
    room = f"{100 + t} * least(x.n - x.at, y.n - y.at) >= {t} * (x.n + y.n)"
    return x.join(y, "h").where("x.comp <> y.comp").where(short).where(room).selectExpr("least(x.id, y.id) a", "greatest(x.id, y.id) b").distinct()


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", n: int = 5, threshold: int = 80) -> DataFrame:
    """For every row: id, n_shingles, component_id, kept. Runs several jobs; intermediate tables go to the shared folder.

    component_id is the smallest id reachable by links, kept says that it is the row's own. A null or empty text, or one
    of white space, has no shingles, links with nothing and is kept. Rows that repeat an id stand for one document, linked
    if any of them is; each is returned. A row with a null id links with nothing, its component is null, it is kept. Texts of
    any length count whole; an empty table gives no rows; other columns are not read, so their names may clash.
    """
    base = docs.select(F.col(id).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"))
    made = [("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("bands", pa.list_(pa.int64()))]
    sets = written(base.mapInArrow(per_text(lambda t: describe(t, n), "text", ["id"], made, SLICE),
                                   "id bigint, n bigint, d1 bigint, d2 bigint, bands array<bigint>"), "sets")
    known = sets.where("id is not null and n > 0")
    reps = written(known.groupBy("d1", "d2", "n").agg(F.min("id").alias("rep")), "representatives")
    ones = reps.select(F.col("rep").alias("id"), "d1", "d2", "n")
    banded = known.join(ones, ["id", "d1", "d2", "n"], "left_semi").select("id", "n", F.explode("bands").alias("k")).distinct()
    banded = banded.select("k", "id", "n")
    # buckets of several documents, each document with its bucket's smallest
    full = banded.groupBy("k").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").select("k", "least")
    member = written(banded.join(full, "k"), "buckets")
    ids = member.select("id").distinct()
    texts = written(base.join(ids, "id", "left_semi"), "texts")

    star = member.where("id > least").select(F.col("least").alias("a"), F.col("id").alias("b")).distinct()
    # sizes alone can rule a link out; the check is on full sets all the same
    size = member.select("id", "n").distinct()
    sized = lambda pairs: pairs.join(size.withColumnsRenamed({"id": "a", "n": "na"}), "a").join(
        size.withColumnsRenamed({"id": "b", "n": "nb"}), "b").where(f"100 * least(na, nb) >= {threshold} * greatest(na, nb)").select("a", "b").distinct()
    repeated = known.join(reps, ["d1", "d2", "n"]).select("id", "rep").groupBy("id").agg(F.min("rep").alias("a"), F.collect_set("rep").alias("all"))
    repeated = repeated.where(F.size("all") > 1).select("a", F.explode("all").alias("b")).where("a <> b")
    own = reps.select(F.col("rep").alias("id"), F.col("rep").alias("comp"))
    label = _new_labels(own.distinct(), verified(sized(star), texts, n, threshold).union(repeated))

    # buckets that still hold several components
    def open_buckets(label: DataFrame) -> DataFrame:
        seen = member.select("k", "id", "n").join(label, "id")
        several = seen.groupBy("k").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("k")
        return written(seen.join(several, "k"), "open")

    left = open_buckets(label)
    if not left.isEmpty():
        shared = written(_shared_shingles(texts, left.select("id").distinct(), n), "shared")
        counts = shared.groupBy("id").agg(F.count("*").alias("u"))
        # every shared shingle of a pair is counted in both documents, so min(u) bounds the intersection
        viable = lambda df: df.join(counts, "id").where(f"100 * u >= {threshold} * n")
        possible = f"100 * least(x.u, y.u) >= {threshold} * (x.n + y.n - least(x.u, y.u))"
        good = written(viable(left), "viable")
        centre = good.groupBy("k").agg(F.max_by(F.struct("id", "n", "u", "comp"), F.struct(F.col("u") / F.col("n"), -F.col("id"))).alias("c")).select("k", "c.*")
        again = good.alias("x").join(centre.alias("y"), "k").where("x.comp <> y.comp").where(possible).selectExpr("y.id a", "x.id b").distinct()
        label = _new_labels(label, verified(again, texts, n, threshold))
        rest = viable(open_buckets(label)).select("id", "n", "u", "comp").distinct()
        pairs = written(_prefix_pairs(shared, rest, threshold), "pairs")
        if not pairs.isEmpty():
            label = _new_labels(label, verified(pairs, texts, n, threshold))

    found = sets.select("id", "n", "d1", "d2").join(reps, ["d1", "d2", "n"], "left")
    found = found.join(label.select(F.col("id").alias("rep"), "comp"), "rep", "left")
    comp = F.when(F.col("n") > 0, F.when(F.col("id").isNotNull(), F.col("comp"))).otherwise(F.col("id"))
    return found.select(F.col("id").alias(id), F.col("n").alias("n_shingles"), comp.alias("component_id"),
                        F.coalesce(F.col("id") == comp, F.lit(True)).alias("kept"))
