"""Stupid-backoff language-model scores of whole texts, computed relationally over the corpus's own n-gram counts.

Grams are byte n-grams (A-Z lower-cased, white space folded to one space) packed exactly into integers, so a count table is
(gram, count) and needs no hash of its text.

1. Texts are packed, in the order they are scanned, into chunks of bounded size, written once to the shared folder.
2. Each chunk explodes into its distinct grams of all orders with their counts (only the longest are sorted out of the
   text; shorter ones follow from them and the ends of texts).
3. The count table sums them by gram, partitioned by hash, and is joined to the chunks' grams. A frequent gram has a row
   for each chunk, not for each place, so no key is hot.
4. Each chunk meets its grams' totals, works out one score for each distinct gram and sums the scores by document.

With leave_one_out each place is scored by the counts without itself, else a corpus would know all its own grams. A gram
left without a count backs off to the shorter one with the factor alpha.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from .common import slices, text_bytes, text_column, written

#: Bytes of text in a chunk (a longer text is a chunk by itself).
CHUNK_BYTES = 12 << 20
#: Places of a chunk whose grams are held at once.
BLOCK = 1 << 20
#: Orders up to this fit, with their length, into 64 bits.
MOST_ORDER = 7


def folded(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) with A-Z lower-cased and each run of ASCII white space one space."""
    gap = (data == 32) | ((data >= 9) & (data <= 13))
    keep = ~gap
    keep[1:] |= gap[1:] & ~gap[:-1]
    keep[:1] = True
    inner = offsets[:-1][offsets[:-1] < len(data)]
    keep[inner] = True
    low = np.where(gap, np.uint8(32), data + np.where((data >= 65) & (data <= 90), np.uint8(32), np.uint8(0)))
    kept = np.concatenate(([0], np.cumsum(keep)))
    return kept[offsets], low[keep]


def folded_slices(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """folded() of all texts, some at a time: what it holds meanwhile is many times its result."""
    offsets, parts = [np.zeros(1, np.int64)], []
    for a, b in slices(texts, BLOCK):
        off, data = folded(*text_bytes(texts.slice(a, b - a)))
        offsets.append(off[1:] + offsets[-1][-1])
        parts.append(data)
    pa.default_memory_pool().release_unused()
    return np.concatenate(offsets), np.concatenate(parts) if parts else np.zeros(0, np.uint8)


def keys_at(data: np.ndarray, ends: np.ndarray, order: int) -> np.ndarray:
    """Packed grams of ``order`` bytes that end at the given places (inclusive)."""
    key = np.full(len(ends), order, np.int64)
    for j in range(order - 1, -1, -1):
        key = key << 8 | data[ends - j]
    return key << np.int64(8 * (MOST_ORDER - order))


def last_grams(offsets: np.ndarray, data: np.ndarray, order: int) -> np.ndarray:
    """Grams of ``order`` bytes at the ends of the texts that are long enough."""
    long = np.flatnonzero(np.diff(offsets) >= order)
    return keys_at(data, offsets[1:][long] - 1, order)


def shorter(keys: np.ndarray, order: int, drop_first: bool) -> np.ndarray:
    """The grams of one byte less: without their first or their last byte."""
    body = keys & ((1 << 56) - 1)
    room = 8 * (MOST_ORDER - order)
    if drop_first:
        body = (body << 8) & ((1 << 56) - 1)
    else:
        body = body >> (room + 8) << (room + 8)
    return body | np.int64(order - 1) << 56


def counted(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and their summed weights."""
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], weights[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(weights, first) if len(first) else weights


def blocks(offsets: np.ndarray, data: np.ndarray, order: int):
    """(first place, last place + 1, grams of ``order`` bytes that end there, which of them lie in one text)."""
    padded = np.concatenate((np.zeros(order - 1, np.uint8), data))
    whole = np.ones(len(data), bool)
    for j in range(order - 1):  # the first bytes of a text have too few before them
        at = offsets[:-1] + j
        whole[at[at < offsets[1:]]] = False
    for a in range(0, len(data), BLOCK):
        b = min(a + BLOCK, len(data))
        key = np.full(b - a, order, np.int64)
        for j in range(order):
            key <<= 8
            key |= padded[a + j:b + j]
        key <<= 8 * (MOST_ORDER - order)
        yield a, b, key, whole[a:b]


def grams(offsets: np.ndarray, data: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct grams of orders 1 to ``order``, counts) of all texts."""
    parts = [np.unique(key[whole], return_counts=True) for _, _, key, whole in blocks(offsets, data, order)]
    keys, counts = counted(*(np.concatenate(x) for x in zip(*parts))) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    all_keys, all_counts = [keys], [counts]
    for k in range(order, 1, -1):
        # a shorter gram is the beginning of a longer one, except at the end of a text
        ends = last_grams(offsets, data, k - 1)
        keys, counts = counted(np.concatenate((shorter(keys, k, False), ends)), np.concatenate((counts, np.ones(len(ends), np.int64))))
        all_keys.append(keys)
        all_counts.append(counts)
    return np.concatenate(all_keys[::-1]), np.concatenate(all_counts[::-1])


def text_sums(offsets: np.ndarray, data: np.ndarray, order: int, keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sum of the values of each text's places; a place with less before it has the value of its shorter gram."""
    size = np.diff(offsets)
    total = np.zeros(len(size))
    for k in range(1, order):
        rows = np.flatnonzero(size >= k)
        total[rows] += values[np.searchsorted(keys, keys_at(data, offsets[:-1][rows] + k - 1, k))]
    longest = np.searchsorted(keys >> 56, order)
    for a, b, key, whole in blocks(offsets, data, order):
        got = np.zeros(b - a)
        got[whole] = look_up(keys[longest:], values[longest:], key[whole])
        i, j = np.searchsorted(offsets, a, side="right") - 1, np.searchsorted(offsets, b)
        bounds = np.clip(offsets[i:j + 1], a, b) - a
        some = np.flatnonzero(np.diff(bounds))
        total[i + some] += np.add.reduceat(got, bounds[some])
    return total


def gram_scores(keys: np.ndarray, totals: np.ndarray, all_bytes: int, alpha: float, leave_one_out: bool) -> np.ndarray:
    """Log score of the last byte of each gram after the bytes before it; keys ascend, shorter grams first."""
    own = 1 if leave_one_out else 0
    order = keys >> 56
    out = np.empty(len(keys))
    for k in range(1, int(order.max(initial=0)) + 1):
        a, b = np.searchsorted(order, k), np.searchsorted(order, k, side="right")
        count = totals[a:b] - own
        if k == 1:
            out[a:b] = np.log(np.maximum(count, 0.5) / max(all_bytes - own, 1))
            continue
        context = totals[np.searchsorted(keys, shorter(keys[a:b], k, False))] - own
        back = out[np.searchsorted(keys, shorter(keys[a:b], k, True))]
        with np.errstate(divide="ignore", invalid="ignore"):
            out[a:b] = np.where(count > 0, np.log(np.maximum(count, 1) / np.maximum(context, 1)), np.log(alpha) + back)
    return out


def look_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Values of wanted keys, all of which are there, by a table with linear steps for keys whose place is taken."""
    bits = max(4, int(np.ceil(np.log2(len(keys) * 2 + 1))))
    mult, mask = np.uint64(0x9E3779B97F4A7C15), (1 << bits) - 1
    home = lambda k: ((k.astype(np.uint64) * mult) >> np.uint64(64 - bits)).astype(np.int64)
    table = np.full(1 << bits, -1, np.int64)
    left, slot = np.arange(len(keys)), home(keys)
    while len(left):
        free = table[slot] < 0
        table[slot[free]] = left[free]  # of several for one place the last stays
        lost = table[slot] != left
        left, slot = left[lost], (slot[lost] + 1) & mask
    slot, out = home(wanted), np.empty(len(wanted))
    left = np.arange(len(wanted))
    while len(left):
        at = table[slot]
        hit = keys[at] == wanted[left]
        out[left[hit]] = values[at[hit]]
        left, slot = left[~hit], (slot[~hit] + 1) & mask
    return out


def _pack(ids: list, offsets: np.ndarray, data: np.ndarray) -> bytes:
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(offsets[:-1]), pa.array(np.diff(offsets))], names=["id", "at", "size"])
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_batch(batch)
    head = sink.getvalue().to_pybytes()
    return zstandard.ZstdCompressor(level=3).compress(b"".join((len(head).to_bytes(8, "big"), head, data)))


def _unpack(blob: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int.from_bytes(raw[:8], "big")
    head = pa.ipc.open_stream(raw[8:8 + n]).read_all().combine_chunks()
    size = head["size"].to_numpy()
    return head["id"].combine_chunks(), np.concatenate(([0], np.cumsum(size))), np.frombuffer(raw, np.uint8, offset=8 + n)


def scores(docs: DataFrame, id: str = "doc_id", text: str = "text", order: int = 5, alpha: float = 0.4, leave_one_out: bool = True) -> DataFrame:
    """Per row: id, n_scored (bytes), log_score (sum), mean_log_score (null without bytes). Runs jobs.

    All rows are counted and scored, repeated ones each. A null or empty text has n_scored 0 and log_score 0. A byte that
    occurs once in the corpus counts one half when left out. Null ids stay null. Order is from 1 to 7.
    """
    if not 1 <= order <= MOST_ORDER:
        raise ValueError("order must be from 1 to 7")

    def pack(batches):
        for batch in batches:
            texts = text_column(batch, "text")
            for a, b in slices(texts, CHUNK_BYTES):
                offsets, data = folded_slices(texts.slice(a, b - a))
                blob = _pack(batch.column(0).slice(a, b - a).to_pylist(), offsets, data)
                yield pa.RecordBatch.from_pydict({"chunk": pa.array([uuid.uuid4().int >> 65], pa.int64()), "bytes": pa.array([len(data)]), "blob": pa.array([blob], pa.binary())})

    read = docs.select(docs[id].cast("bigint").alias("id"), docs[text].cast("string").alias("text"))
    chunks = written(read.mapInArrow(pack, "chunk bigint, bytes bigint, blob binary"), "chunks")

    def explode(batches):
        for batch in batches:
            for chunk, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                _, offsets, data = _unpack(blob)
                keys, counts = grams(offsets, data, order)
                yield pa.RecordBatch.from_pydict({"chunk": pa.array(np.full(len(keys), chunk)), "gram": pa.array(keys), "n": pa.array(counts.astype(np.int32))})

    exploded = written(chunks.select("chunk", "blob").mapInArrow(explode, "chunk bigint, gram bigint, n int"), "grams")
    table = exploded.groupBy("gram").agg(F.sum("n").alias("total"))
    # one row of one number
    all_bytes = chunks.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    known = exploded.select("chunk", "gram").join(table, "gram")

    def score(text: pa.Table, counts: pa.Table) -> pa.Table:
        out = []
        for blob in text["blob"].to_pylist():
            ids, offsets, data = _unpack(blob)
            keys, totals = counts["gram"].to_numpy(), counts["total"].to_numpy()
            at = np.argsort(keys)
            keys = keys[at]
            values = gram_scores(keys, totals[at], all_bytes, alpha, leave_one_out)
            total, size = text_sums(offsets, data, order, keys, values), np.diff(offsets)
            out.append(pa.table({"id": ids, "n_scored": pa.array(size), "log_score": pa.array(total)}))
        return pa.concat_tables(out) if out else pa.table({"id": pa.array([], pa.int64()), "n_scored": pa.array([], pa.int64()), "log_score": pa.array([], pa.float64())})

    done = chunks.select("chunk", "blob").groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(score, "id bigint, n_scored bigint, log_score double")
    return done.select(F.col("id").alias(id), "n_scored", "log_score", (F.col("log_score") / F.nullif(F.col("n_scored"), F.lit(0))).alias("mean_log_score"))
