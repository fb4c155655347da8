"""Best-fit packing of token sequences after Martello-Toth dominance reduction.

Documents are tokenized by the tokenizers library; what is longer than a sequence is cut into full pieces and a rest.
Only lengths matter for packing, and there are at most ``capacity`` of them, so the instance is a histogram of piece
lengths: one bounded row per length reaches the driver, whatever the number of documents.

* Reduction: a set of pieces is fixed as a sequence for good if it dominates every other feasible set with its piece j,
  that is, each such set's other pieces fit into the places of the fixed ones. So j is fixed with a piece that fills its
  sequence exactly; alone if nothing fits beside it; with the largest fitting piece i if at most one other piece fits, or
  if at most two fit and no fitting pair is longer than i. An optimal packing keeps its number of sequences.
* The rest goes by best fit decreasing, equal lengths at a time: pieces join the fullest open sequences they fit in.

Both give patterns (how many sequences hold which lengths), as intervals of the rank of a piece among those of its
length. Pieces are ranked in parallel: counted by (length, bucket), numbered inside, shifted by the buckets before.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, bisect_right, insort
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from .common import ragged, slices, text_column, text_words, written

# --- the instance on the driver: lengths and counts -------------------------------------------------


class Lengths:
    """Multiset of lengths by counts, with the lengths present in order."""

    def __init__(self, counts: dict[int, int]):
        self.count = {s: n for s, n in counts.items() if n > 0}
        self.order = sorted(self.count)

    def take(self, length: int, n: int) -> None:
        self.count[length] -= n
        if not self.count[length]:
            del self.count[length]
            self.order.remove(length)

    def least(self, n: int, without: int) -> list[int]:
        """The n smallest, one piece of length ``without`` left out."""
        out: list[int] = []
        for s in self.order:
            out += [s] * min(n - len(out), self.count[s] - (s == without))
            if len(out) == n:
                break
        return out

    def largest_to(self, most: int, without: int) -> int | None:
        """Largest length up to ``most``, one piece of length ``without`` left out."""
        i = bisect_right(self.order, most) - 1
        if i >= 0 and self.order[i] == without and self.count[without] == 1:
            i -= 1
        return self.order[i] if i >= 0 else None

    def best_pair(self, most: int, without: int) -> int:
        """Largest sum of two pieces up to ``most``, one piece of length ``without`` left out; 0 if none."""
        best, hi = 0, len(self.order) - 1
        for i, a in enumerate(self.order):
            while hi >= i and self.order[hi] + a > most:
                hi -= 1
            for j in range(hi, i - 1, -1):
                b = self.order[j]
                need_a = (a == without) + (2 if a == b else 1)
                if self.count[a] >= need_a and self.count[b] >= (b == without) + 1:
                    best = max(best, a + b)
                    break
            if hi < i:
                break
        return best


def reduce_by_dominance(lengths: Lengths, capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns (sequences, [(length, pieces in each)]) fixed by dominance; they are taken out of ``lengths``."""
    fixed = []

    def fix(n: int, *pieces: int) -> None:
        each = {s: pieces.count(s) for s in pieces}
        for s, k in each.items():
            lengths.take(s, n * k)
        fixed.append((n, list(each.items())))

    changed = True
    while changed:
        changed = False
        for j in sorted(lengths.order, reverse=True):
            while j in lengths.count:
                rest, n = capacity - j, lengths.count[j]
                small = lengths.least(3, j)
                if rest in lengths.count and (rest != j or n > 1):
                    fix(n // 2 if rest == j else min(n, lengths.count[rest]), j, rest)
                elif not small or small[0] > rest:
                    fix(n, j) if rest < j or n == 1 else fix(1, j)
                else:
                    i = lengths.largest_to(rest, j)
                    one = len(small) < 2 or small[0] + small[1] > rest
                    two = len(small) < 3 or sum(small) > rest
                    if not one and not (two and lengths.best_pair(rest, j) <= i):
                        break
                    # fewer pieces only make the conditions easier to meet, so all such pairs are fixed at once
                    fix(n // 2 if i == j else min(n, lengths.count[i]), j, i)
                changed = True
    return fixed


def best_fit(lengths: Lengths, capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns of best fit decreasing for all of ``lengths``, equal pieces at a time."""
    open_: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}
    rooms: list[int] = []  # rooms left for which open_ has sequences, in order

    def put(room: int, n: int, pieces: list[tuple[int, int]]) -> None:
        if room not in open_:
            open_[room] = []
            insort(rooms, room)
        open_[room].append((n, pieces))

    for s in sorted(lengths.order, reverse=True):
        left = lengths.count[s]
        while left:
            i = bisect_left(rooms, s)
            if i < len(rooms):
                room = rooms[i]
                n, pieces = open_[room].pop()
                if not open_[room]:
                    del open_[room], rooms[i]
                # one sequence after the other is filled as far as it goes
                k = room // s
                m = min(n, left // k)
                if m:
                    put(room - k * s, m, [*pieces, (s, k)])
                    left -= m * k
                    if n > m:
                        put(room, n - m, pieces)
                else:
                    put(room - left * s, 1, [*pieces, (s, left)])
                    if n > 1:
                        put(room, n - 1, pieces)
                    left = 0
            else:
                k = capacity // s
                if left >= k:
                    put(capacity - k * s, left // k, [(s, k)])
                if left % k:
                    put(capacity - (left % k) * s, 1, [(s, left % k)])
                left = 0
    return [x for room in rooms for x in open_[room]]


def plan(counts: dict[int, int], capacity: int) -> dict[str, np.ndarray]:
    """Intervals of (length, rank): lo, pieces in each sequence, first sequence, offset in it; sorted by (length, lo)."""
    lengths = Lengths(counts)
    patterns = reduce_by_dominance(lengths, capacity) + best_fit(lengths, capacity)
    used: dict[int, int] = dict.fromkeys(counts, 0)
    rows, sequence = [], 0
    for n, pieces in patterns:
        offset = 0
        for s, k in pieces:
            rows.append((s, used[s], k, sequence, offset))
            used[s] += n * k
            offset += s * k
        sequence += n
    assert used == counts, "every piece has a place"
    rows.sort()
    cols = np.array(rows, np.int64).reshape(-1, 5).T
    return dict(zip(("length", "lo", "k", "sequence", "offset"), cols)) | {"sequences": sequence}


# --- tokens -----------------------------------------------------------------------------------------

#: Words that a tokenizer of runs of letters and runs of signs cuts at one known place at most, by characters on which
#: every version of Unicode agrees: letters of ASCII and Latin-1, and such a word with a run of ASCII signs after it.
LETTERS = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]"
SIGNS = ".,;:!?%$&#*"
#: Bytes of text whose words are told apart at once.
WORDS_OF = 3 << 20


@lru_cache(2)
def tokenizers_of(path: str):
    """(the tokenizer; its model alone, for words of letters, or None if it is of another kind; marks of the ids that end
    a word)."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    from tokenizers import Tokenizer, normalizers, pre_tokenizers

    whole, bare = Tokenizer.from_file(path), Tokenizer.from_file(path)
    coded = lambda t: whole.encode(t, add_special_tokens=False).ids
    if any(coded(t) != [i for w in t.split() for i in coded(w)] for t in ("hello big world", "a  b\n\tc1 2,3 ", " Été déjà vu")):
        raise ValueError(f"{path}: its ids depend on white space; only tokenizers that drop it are packed here")
    suffix = getattr(whole.model, "end_of_word_suffix", None)
    cuts = repr(whole.pre_tokenizer)
    if not suffix or "Lowercase" not in repr(whole.normalizer) or r"[\p{L}]+" not in cuts or r"[^\s\p{L}\p{N}]+" not in cuts:
        return whole, None, None
    bare.normalizer = normalizers.Sequence([])
    bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    ends = np.zeros(whole.get_vocab_size() + 1, bool)
    for token, i in whole.get_vocab(with_added_tokens=False).items():
        ends[i] = token.endswith(suffix)
    return whole, bare, ends


def _encoded(whole, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    found = [e.ids for e in whole.encode_batch_fast(words.to_pylist(), add_special_tokens=False)]
    size = np.fromiter(map(len, found), np.int64, len(found))
    return np.fromiter((i for ids in found for i in ids), np.uint32, int(size.sum())), size


def word_ids(words: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids of the distinct words one after the other, number of ids of each)."""
    whole, bare, is_end = tokenizers_of(path)
    simple = np.zeros(len(words), bool)
    if bare is not None and len(words):
        simple = pc.match_substring_regex(words, f"^{LETTERS}+[{re.escape(SIGNS)}]*$").to_numpy(zero_copy_only=False)
    rows, others = np.flatnonzero(simple), np.flatnonzero(~simple)
    size = np.zeros(len(words), np.int64)
    parts = []  # (words, their places in a pool of ids, lengths, pool)
    if len(rows):
        some = words.take(pa.array(rows))
        letters = pc.utf8_rtrim(some, SIGNS)
        base = pc.utf8_lower(letters).dictionary_encode()
        ids = np.array(bare.encode_batch_fast(["\n".join(base.dictionary.to_pylist())], add_special_tokens=False)[0].ids, np.uint32)
        stop = np.flatnonzero(is_end[ids]) + 1
        each = np.diff(np.concatenate(([0], stop)))
        if len(each) != len(base.dictionary):
            raise ValueError("every word of letters must end with one word-end token")
        at = base.indices.to_numpy(zero_copy_only=False)
        parts.append((rows, (stop - each)[at], each[at], ids))
        signed = pc.not_equal(pc.binary_length(some), pc.binary_length(letters))
        tails = pc.utf8_ltrim(some.filter(signed), "".join(map(chr, (*range(65, 91), *range(97, 123), *range(0xc0, 0x100))))).dictionary_encode()
        ids, each = _encoded(whole, tails.dictionary)
        at = tails.indices.to_numpy(zero_copy_only=False)
        parts.append((rows[signed.to_numpy(zero_copy_only=False)], (np.cumsum(each) - each)[at], each[at], ids))
    ids, each = _encoded(whole, words.take(pa.array(others)))
    parts.append((others, np.cumsum(each) - each, each, ids))
    for at, _, length, _ in parts:
        size[at] += length
    free = np.cumsum(size) - size
    out = np.empty(int(size.sum()), np.uint32)
    for at, start, length, pool in parts:
        out[ragged(free[at], length)] = pool[ragged(start, length)]
        free[at] += length
    return out, size


def token_ids(texts: pa.Array, path: str, end: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, each with ``end`` after it; where each text ends). Words between ASCII white space are
    tokenized once for all their places in ``texts``: the tokenizer must drop white space and treat such words alone.
    Words of letters go to the library's model directly, all others through its whole chain."""
    words, per = text_words(texts)
    coded = words.dictionary_encode()
    flat, size = word_ids(coded.dictionary, path)
    at = coded.indices.to_numpy(zero_copy_only=False)
    length = size[at]
    ids = flat[ragged((np.cumsum(size) - size)[at], length)]
    ends = np.concatenate(([0], np.cumsum(length)))[np.cumsum(per)]
    return np.insert(ids, ends, np.uint32(end)), ends + np.arange(1, len(ends) + 1)


def cut_pieces(docs: DataFrame, path: str, capacity: int, id: str, text: str, end: int, with_ids: bool) -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32 (and ids)."""

    def run(batches):
        for batch in batches:
            texts = text_column(batch, "text")
            for a, b in slices(texts, WORDS_OF):
                pa.default_memory_pool().release_unused()
                ids, ends = token_ids(texts.slice(a, b - a), path, end)
                size = np.diff(np.concatenate(([0], ends)))
                cuts = -(-size // capacity)
                owner = np.repeat(np.arange(len(size)), cuts)
                piece = np.arange(len(owner)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
                start = piece * capacity
                length = np.minimum(size[owner] - start, capacity)
                first = (ends - size)[owner] + start
                raw = memoryview(ids.astype("<u4")).cast("B")
                crc = [zlib.crc32(raw[4 * i:4 * (i + n)]) for i, n in zip(first.tolist(), length.tolist())]
                cols = [batch.column(0).slice(a, b - a).take(pa.array(owner)), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
                if with_ids:
                    cols.append(pa.LargeListArray.from_arrays(pa.array(np.append(first, len(ids))), pa.array(ids.astype(np.int32))).cast(pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, names=["id", "piece", "start", "length", "ids_crc32", "ids"][:len(cols)])

    base = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    kind = docs.schema[id].dataType.simpleString()
    return base.mapInArrow(run, f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids)


def pack(docs: DataFrame, path: str, capacity: int = 2048, id: str = "doc_id", text: str = "text", end: int = 0,
         with_ids: bool = False) -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32, (ids,) sequence_id, offset. Runs jobs: tokens are written once to
    the shared folder, then counted by length.

    path: a file of the tokenizers library, readable on the executors. A null or empty text is one piece holding the end
    id. Every row is packed, rows that repeat an id too (their pieces then repeat id and piece); a null id stays null. An
    empty table gives an empty result. Sequences are gapless from offset 0; their numbers have no meaning.
    """
    spark = docs.sparkSession
    pieces = cut_pieces(docs, path, capacity, id, text, end, with_ids)
    pieces = written(pieces, "pieces")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = pieces.withColumn("bucket", F.pmod(F.xxhash64("id", "piece"), F.lit(parts)))
    counts = written(keyed.groupBy("length", "bucket").count(), "counts")
    # at most one row for each length up to the capacity
    table = plan({r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("count")).collect()}, capacity)
    before = counts.select("length", "bucket", (F.sum("count").over(Window.partitionBy("length").orderBy("bucket")) - F.col("count")).alias("shift"))
    inside = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("id", "piece")) - 1
    ranked = keyed.withColumn("inside", inside).join(before.hint("merge"), ["length", "bucket"])  # it grows with the buckets: no broadcast
    ranked = ranked.withColumn("rank", F.col("inside") + F.col("shift"))
    names = ["id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]

    def place(batches):
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            lo = np.searchsorted(table["length"], length, side="left")
            hi = np.searchsorted(table["length"], length, side="right")
            while (lo + 1 < hi).any():  # the last interval of the length that starts at or before the rank
                mid = (lo + hi) // 2
                right = (lo + 1 < hi) & (table["lo"][np.minimum(mid, len(table["lo"]) - 1)] <= rank)
                lo, hi = np.where(right, mid, lo), np.where(right | (lo + 1 >= hi), hi, mid)
            nth = rank - table["lo"][lo]
            k = table["k"][lo]
            cols = [batch.column(batch.schema.get_field_index(c)) for c in names]
            cols += [pa.array(table["sequence"][lo] + nth // k), pa.array(table["offset"][lo] + nth % k * length)]
            yield pa.RecordBatch.from_arrays(cols, names=[*names, "sequence_id", "offset"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.select(*names).schema) + ", sequence_id bigint, offset bigint"
    return ranked.select(*names, "rank").mapInArrow(place, kinds).withColumnRenamed("id", id)
