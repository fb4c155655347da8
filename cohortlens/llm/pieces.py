"""SentencePiece (BPE) encoding and decoding by suffix-array matching.

The distinct units of a slice of texts (a run of spaces and what follows to the next one; no vocabulary piece reaches
across) are laid end to end and indexed by a suffix array, sorted as deep as the longest piece. Every piece of the vocabulary is
found in it by bisection, vectorised over pieces, which gives the range of all its occurrences. The occurrences are edges
from start to end; sorted by end, they are relaxed for all units side by side.

A BPE model has no path costs. Its path is the one whose every two neighbouring pieces are what BPE itself makes of their
joined text, and only one edge into each position goes on from its start like that. So an edge is admitted if the last
piece at its start and its own piece may meet; whether two pieces may meet is worked out once and kept. Characters that
the vocabulary lacks are single edges and become byte pieces.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import per_text, ragged, slices, text_bytes, text_column

SPACE = "▁"
#: Bytes of text whose units are indexed at once.
INDEXED = 4 << 20
#: Slots of the table of pairs that may or may not meet; a slot may be overwritten, which costs time only.
SLOTS = 1 << 21


class Vocabulary:
    """Pieces of a model with what the matching needs. Control, unknown, unused and byte pieces match no text."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.size = n
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.piece = {i: model.id_to_piece(i) for i in plain}
        self.id_of = {p: i for i, p in self.piece.items()}
        self.score = {i: model.get_score(i) for i in plain}
        self.byte_id = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.uint32)
        if any(SPACE in p.lstrip(SPACE) for p in self.id_of):
            raise ValueError("a piece reaches across a space")
        for probe in ("ﬁ  Å x ", " a", "½\t\n\u3000"):
            got = b"".join(bytes([int(q[3:5], 16)]) if model.is_byte(i) else q.encode() for i in model.encode(probe) for q in [model.id_to_piece(i)])
            if got.decode() != SPACE + probe.replace(" ", SPACE):
                raise ValueError("the model's normaliser changes texts, or adds no space before them")
        chars = sorted({c for p in self.id_of for c in p})
        self.code = np.zeros(0x110000, np.uint16)  # 0: no piece has it
        self.code[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        if len(chars) >= 0xFFFF:
            raise ValueError("too many characters")
        self.deep = max(map(len, self.id_of))
        self.words = -(-self.deep // 4)
        self.ids = np.array(plain, np.int64)
        self.length = np.array([len(self.piece[i]) for i in plain], np.int64)
        codes = np.zeros((2, len(plain), 4 * self.words), np.uint64)
        for row, i in enumerate(plain):
            got = self.code[[ord(c) for c in self.piece[i]]]
            codes[:, row, :len(got)] = got
            codes[1, row, len(got):] = 0xFFFF
        self.low, self.high = (self._packed(c) for c in codes)
        # decoding: bytes of each id
        out = [b""] * n
        for i, p in self.piece.items():
            out[i] = p.replace(SPACE, " ").encode()
        for b, i in enumerate(self.byte_id):
            out[i] = bytes([b])
        self.out_size = np.array([len(x) for x in out], np.int64)
        self.out_at = np.cumsum(self.out_size) - self.out_size
        self.out = np.frombuffer(b"".join(out), np.uint8)
        self.slot_key = np.full(SLOTS, -1, np.int64)
        self.slot_ok = np.zeros(SLOTS, bool)

    @staticmethod
    def _packed(codes: np.ndarray) -> np.ndarray:
        """(words, rows): four 16-bit codes in each word, the first on top."""
        c = codes.reshape(len(codes), -1, 4)
        return (c[:, :, 0] << np.uint64(48) | c[:, :, 1] << np.uint64(32) | c[:, :, 2] << np.uint64(16) | c[:, :, 3]).T.copy()

    def merged(self, text: str) -> list[str]:
        """BPE of a short text: always the best-scored pair, the leftmost of equals."""
        seq = list(text)
        while len(seq) > 1:
            best, at = None, -1
            for i in range(len(seq) - 1):
                s = self.score.get(self.id_of.get(seq[i] + seq[i + 1], -1))
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            seq[at:at + 2] = [seq[at] + seq[at + 1]]
        return seq

    def may_meet(self, last: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Whether piece may follow last (-1: nothing, or a character without a piece)."""
        key = (last + 1) * self.size + piece
        slot = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(43)).astype(np.int64)
        unknown = np.flatnonzero(self.slot_key[slot] != key)
        ok = self.slot_ok[slot]
        if len(unknown):
            fresh, back = np.unique(key[unknown], return_inverse=True)
            got = np.empty(len(fresh), bool)
            for i, k in enumerate(fresh.tolist()):
                a, b = divmod(k, self.size)
                b = self.piece[b]
                a = self.piece[a - 1] if a else ""
                got[i] = self.merged(a + b) == ([a, b] if a else [b])
            ok[unknown] = got[back]
            self.slot_key[slot[unknown]], self.slot_ok[slot[unknown]] = key[unknown], ok[unknown]
        return ok


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def suffix_array(codes: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(places in suffix order, (words, places) the packed beginnings in that order) as deep as 4 * words characters."""
    n = len(codes)
    c = np.zeros(n + 4 * words, np.uint64)
    c[:n] = codes
    four = c[:-3] << np.uint64(48) | c[1:-2] << np.uint64(32) | c[2:-1] << np.uint64(16) | c[3:]
    # ranks of four characters, doubled until the depth is reached
    _, rank = np.unique(four, return_inverse=True)
    rank, depth = rank.astype(np.int64), 4
    while depth < 4 * words:
        pair = rank[:-depth] * np.int64(len(rank)) + rank[depth:] if len(rank) > depth else rank
        _, r = np.unique(pair, return_inverse=True)
        rank = np.concatenate((r.astype(np.int64), np.zeros(len(rank) - len(r), np.int64)))
        depth *= 2
    order = np.argsort(rank[:n], kind="stable")
    return order, np.stack([four[np.minimum(order + 4 * w, len(four) - 1)] for w in range(words)])


def bisect(sorted_words: np.ndarray, wanted: np.ndarray, right: bool) -> np.ndarray:
    """For all wanted (words, m) at once: how many suffixes are less (or, right, not greater)."""
    lo, hi = np.zeros(wanted.shape[1], np.int64), np.full(wanted.shape[1], sorted_words.shape[1], np.int64)
    while True:
        open_ = lo < hi
        if not open_.any():
            return lo
        mid = np.minimum((lo + hi) // 2, sorted_words.shape[1] - 1)
        less, same = np.zeros(len(lo), bool), np.ones(len(lo), bool)
        for w in range(len(wanted)):
            at = sorted_words[w][mid]
            less |= same & (at < wanted[w])
            same &= at == wanted[w]
        go = open_ & (less | same if right else less)
        lo, hi = np.where(go, mid + 1, lo), np.where(open_ & ~go, mid, hi)


def encode_units(v: Vocabulary, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids of the units one after the other, number of ids of each). points: code points of all units."""
    codes = v.code[points]
    n = len(codes)
    if not n:
        return np.zeros(0, np.uint32), np.zeros(len(starts), np.int64)
    # a gap of one foreign character after each unit keeps matches inside
    shift = np.repeat(np.arange(len(starts)), ends - starts)
    place = np.arange(n) + shift
    spaced = np.zeros(n + len(starts), np.uint16)
    spaced[place] = codes
    order, packed = suffix_array(spaced, v.words)
    lo, hi = bisect(packed, v.low, False), bisect(packed, v.high, True)
    count = hi - lo
    begin = order[ragged(lo, count)]
    piece, length = np.repeat(v.ids, count), np.repeat(v.length, count)
    first = starts + np.arange(len(starts))
    unit_of = np.zeros(n + len(starts), np.int64)
    unit_of[place] = shift
    unit_of[ends + np.arange(len(starts))] = np.arange(len(starts))
    # characters no piece has, and such as are no piece by themselves, are edges of their own
    alone = place[(codes == 0) | ~np.isin(points, [ord(p) for p in v.id_of if len(p) == 1])]
    begin = np.concatenate((begin, alone))
    piece = np.concatenate((piece, np.full(len(alone), -1)))
    length = np.concatenate((length, np.ones(len(alone), np.int64)))
    reach = begin + length - first[unit_of[begin]]
    by_end = np.argsort(reach.astype(np.uint16) if reach.max(initial=0) < 1 << 16 else reach, kind="stable")
    begin, piece, length, reach = begin[by_end], piece[by_end], length[by_end], reach[by_end]
    last = np.full(n + len(starts) + 1, -1, np.int64)
    back = np.zeros(n + len(starts) + 1, np.int64)
    cut = np.concatenate(([0], np.flatnonzero(np.diff(reach)) + 1, [len(reach)]))
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
        s, p, l = begin[a:b], piece[a:b], length[a:b]
        single = p < 0
        ok = single.copy()
        real = np.flatnonzero(~single)
        ok[real] = v.may_meet(last[s[real]], p[real])
        e = (s + l)[ok]
        last[e], back[e] = p[ok], l[ok]
    # walk back from the ends of all units together
    at, base = ends + np.arange(len(starts)), first
    steps, live = [], np.flatnonzero(at > base)
    while len(live):
        here = at[live]
        steps.append((live, here, last[here]))
        at[live] = here - back[here]
        live = live[at[live] > base[live]]
    if not steps:
        return np.zeros(0, np.uint32), np.zeros(len(starts), np.int64)
    unit, end, ids = (np.concatenate(x) for x in zip(*steps))
    back_order = np.lexsort((end, unit))
    unit, end, ids = unit[back_order], end[back_order], ids[back_order]
    lone = np.flatnonzero(ids < 0)
    if len(lone):  # bytes of characters without a piece
        raw = [chr(c).encode("utf-8", "surrogatepass") for c in points[(end - 1 - unit)[lone]].tolist()]
        width = np.ones(len(ids), np.int64)
        width[lone] = [len(x) for x in raw]
        out = np.empty(int(width.sum()), np.int64)
        free = np.cumsum(width) - width
        out[free] = ids
        out[ragged(free[lone], width[lone])] = v.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
        unit, ids = np.repeat(unit, width), out
    return ids.astype(np.uint32), np.bincount(unit, minlength=len(starts))


def encode_texts(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts one after the other, number of ids of each), as the sentencepiece library gives them for a model
    with a dummy prefix, escaped spaces and no other normalisation."""
    v = vocabulary(path)
    offsets, data = text_bytes(texts)
    points = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    points[points == 0x20] = ord(SPACE)
    first_byte = np.flatnonzero((data & 0xC0) != 0x80)
    bounds = np.searchsorted(first_byte, offsets)
    full = np.flatnonzero(np.diff(bounds))
    points = np.insert(points, bounds[:-1][full], ord(SPACE))  # the dummy prefix
    bounds = bounds + np.searchsorted(full, np.arange(len(bounds)))
    space = points == ord(SPACE)
    begins = space.copy()
    begins[1:] &= ~space[:-1]
    begins[bounds[:-1][full]] = True
    starts = np.flatnonzero(begins)
    raw = points.astype("<u4").tobytes()
    units = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(points)) * 4), pa.py_buffer(raw)])
    coded = units.dictionary_encode()
    at = coded.indices.to_numpy(zero_copy_only=False)
    off, distinct = text_bytes(coded.dictionary)
    ids, size = encode_units(v, distinct.view("<u4"), off[:-1] // 4, off[1:] // 4)
    length = size[at]
    flat = ids[ragged((np.cumsum(size) - size)[at], length)]
    ends = np.concatenate(([0], np.cumsum(length)))[np.searchsorted(starts, bounds)]
    return flat, np.diff(ends)


def decode_ids(ids: np.ndarray, sizes: np.ndarray, path: str) -> pa.Array:
    """Texts of id sequences: pieces joined, spaces restored, the dummy prefix taken off, broken bytes replaced."""
    v = vocabulary(path)
    ids = ids.astype(np.int64)
    width = v.out_size[ids]
    data = v.out[ragged(v.out_at[ids], width)]
    ends = np.concatenate(([0], np.cumsum(width)))[np.concatenate(([0], np.cumsum(sizes)))]
    lead = np.zeros(len(sizes), np.int64)
    full = np.diff(ends) > 0
    lead[full] = data[ends[:-1][full]] == 0x20
    raw = data.tobytes()
    return pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip((ends[:-1] + lead).tolist(), ends[1:].tolist())], pa.large_string())


def encode(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, ids (array<int>). A null or empty text has no ids; every row is encoded, repeated ones too, texts of any
    length whole; an empty table gives no rows; other columns are not read, so their names may clash. One scan, no shuffle.

    path: a sentencepiece BPE model file readable on the executors.
    """
    def fn(batches):
        for batch in batches:
            texts = text_column(batch, "text")
            for a, b in slices(texts, INDEXED):
                ids, size = encode_texts(texts.slice(a, b - a), path)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))).astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], names=["id", "ids"])

    read = docs.select(docs[id].alias("id"), docs[text].cast("string").alias("text"))
    return read.mapInArrow(fn, f"id {docs.schema[id].dataType.simpleString()}, ids array<int>").withColumnRenamed("id", id)


def decode(encoded: DataFrame, path: str, id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Per row: id, text of a list of ids; a null list gives a null text, an empty one ''; lists of any length; an empty table
    gives no rows; other columns are not read."""
    def fn(batches):
        for batch in batches:
            lists = batch.column(1)
            size = np.diff(lists.offsets.to_numpy())
            made = decode_ids(lists.flatten().to_numpy(zero_copy_only=False), np.where(lists.is_valid().to_numpy(zero_copy_only=False), size, 0), path)
            made = pa.array([x if ok else None for x, ok in zip(made.to_pylist(), lists.is_valid().to_pylist())], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), made], names=["id", "text"])

    read = encoded.select(encoded[id].alias("id"), encoded[ids].cast("array<int>").alias("ids"))
    return read.mapInArrow(fn, f"id {encoded.schema[id].dataType.simpleString()}, text string").withColumnRenamed("id", id)


def round_trip(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, n_pieces, ids_crc32 (of unsigned little-endian 32-bit ids), restored (decoding gives the text back).

    Encodes and decodes each slice in one pass, so ids need not leave the task. A null or empty text has no pieces and is
    restored as ''. A literal U+2581 reads like a space and comes back as one. Repeated rows are encoded each, texts of any
    length whole; an empty table gives no rows; other columns are not read, so their names may clash.
    """
    def fn(texts: pa.Array) -> dict[str, pa.Array]:
        ids, size = encode_texts(texts, path)
        ends = np.cumsum(size)
        raw = memoryview(ids.astype("<u4")).cast("B")
        crc = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip((ends - size).tolist(), ends.tolist())]
        same = pc.equal(decode_ids(ids, size, path), texts)
        return {"n_pieces": pa.array(size), "ids_crc32": pa.array(crc, pa.int64()), "restored": same}

    made = [("n_pieces", pa.int64()), ("ids_crc32", pa.int64()), ("restored", pa.bool_())]
    read = docs.select(docs[id].alias("id"), docs[text].cast("string").alias("text"))
    kinds = f"id {docs.schema[id].dataType.simpleString()}, n_pieces bigint, ids_crc32 bigint, restored boolean"
    return read.mapInArrow(per_text(fn, "text", ["id"], made, INDEXED), kinds).withColumnRenamed("id", id)
