"""Alignment of two tokenizers over the same texts, with corpus-wide link counts from inverted pair bitmaps.

Both tokenizers cut space + text into tokens; where tokens of both end, a group ends; an A and a B token whose bytes overlap
are linked. Between two neighbouring token ends of either kind lies exactly one link, so links are read off the merged ends.

1. Texts are cut before spaces and line ends that follow a character which is no white space: no token of either kind
   reaches across, so a stretch is coded by the libraries once and kept, as long as it comes again, for a worker's later texts.
2. Documents of a task are numbered in blocks. For every linked id pair a block has one posting: a compressed bitmap of its
   documents and multiplicity planes (plane k: documents where bit k of the link count less one is set). Parts of a long
   document are merged into the one bit it has. Blocks are disjoint, so the corpus-wide OR of a pair's bitmaps is their
   union and its popcount the sum over blocks: what is shuffled for a count is one number for each block and pair.
3. Postings meet their pair's count and whether it is the highest of the A id, go back to their blocks, and hand count and
   multiplicity to every document whose bit is set.

A frequent pair has one posting for each block, not one row for each document.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import ragged, slices, text_bytes, text_column, written
from .token_counts import _byte_of_symbol

#: Bytes of text coded at once; a longer text is coded in parts of about this size.
PART_BYTES = 2 << 20
#: Coded stretches that a worker keeps; then those met once or not since the last time are dropped.
KEPT = 250_000
#: A block ends at so many documents (positions are 16 bits) or so many (document, pair) entries.
BLOCK_DOCS, BLOCK_ENTRIES = 1 << 16, 1_200_000
#: Rows numbered together; fewer than a block's documents.
BATCH_ROWS = 8192
#: Last two bytes of white space characters beyond ASCII (and of some that were white space once); no cut follows them.
SPACES = np.array([0xC285, 0xC2A0, 0x9A80, 0xA08E, 0x819F, 0xBBBF, *range(0x8080, 0x808C), 0x80A8, 0x80A9, 0x80AF], np.uint16)


class Pair:
    """The two tokenizers with the bytes of their tokens."""

    def __init__(self, path_a: str, path_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks share the cores already
        import json

        import sentencepiece
        import tokenizers

        spec = json.load(open(path_a, encoding="utf-8"))
        split = spec["pre_tokenizer"] or {}
        if split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True) or spec["normalizer"] or spec["model"]["type"] != "BPE":
            raise ValueError(f"{path_a}: not a byte-level BPE without prefix space and normalizer")
        self.a = tokenizers.Tokenizer.from_file(path_a)
        self.a.no_truncation(), self.a.no_padding()
        self.a.encode_special_tokens = True
        symbol = _byte_of_symbol()
        special = {t["id"] for t in spec["added_tokens"]}
        bytes_a = {i: b"" if i in special else bytes(symbol[c] for c in t) for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        n = self.b.get_piece_size()
        bytes_b = {i: bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode() for i in range(n)}
        if any(" " in p.lstrip(b" ").decode("utf-8", "replace") for i, p in bytes_b.items() if not self.b.is_control(i)):
            raise ValueError(f"{path_b}: a piece reaches across a space")
        # a dummy prefix, no other normalisation
        for probe, want in (("ﬁ  Å x ", " ﬁ  Å x "), (" a", "  a"), ("½\t\n", " ½\t\n")):
            if b"".join(bytes_b[i] for i in self.b.encode(probe)).decode() != want:
                raise ValueError(f"{path_b}: its normaliser changes texts")
        self.table_a, self.table_b = self._table(bytes_a), self._table(bytes_b)
        self.lone = self.b.piece_to_id("▁")
        #: whether no piece of B holds a line end beside something else, so that texts may be cut there
        self.lines = not any(b"\n" in p and p != b"\n" for p in bytes_b.values())
        self.store = Store(self)

    @staticmethod
    def _table(found: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, size, all bytes) of the tokens' bytes by id."""
        rows = [found.get(i, b"") for i in range(max(found) + 1)]
        size = np.array([len(x) for x in rows], np.int64)
        return np.cumsum(size) - size, size, np.frombuffer(b"".join(rows), np.uint8)

    def ids(self, stretches: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """A's and B's ids of stretches that begin with a space or a line end."""
        a = [x.ids for x in self.a.encode_batch_fast(stretches, add_special_tokens=False)]
        # the library adds a first space itself, though not to an empty text; before a line end it is a piece of its own
        b = self.b.encode([x[1:] if x[0] == " " else x for x in stretches], num_threads=1)
        return a, [(y or [self.lone]) if x[0] == " " else y[1:] for x, y in zip(stretches, b)]


@lru_cache(2)
def pair(path_a: str, path_b: str) -> Pair:
    return Pair(path_a, path_b)


def safe_cuts(data: np.ndarray, lines: bool) -> np.ndarray:
    """Places of spaces (lines: and line ends) that follow a character which is no white space: tokens of both kinds begin there."""
    here = data[1:] == 32
    at = np.flatnonzero(here | (data[1:] == 10) if lines else here) + 1
    last = data[at - 1]
    two = data[np.maximum(at - 2, 0)].astype(np.uint16) << 8 | last
    return at[((last > 32) & (last < 127)) | ((last >= 128) & ~np.isin(two, SPACES))]


def parts_of(texts: pa.Array, most: int, lines: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, bool]]:
    """(texts' numbers, bytes, where each begins, last part of them?): space + text for all texts that are not empty, some
    at a time, a long one in parts that are cut at safe places."""
    for a, b in slices(texts, most):
        offsets, data = text_bytes(texts.slice(a, b - a))
        rows = np.flatnonzero(np.diff(offsets))
        if not len(rows):
            continue
        data = np.insert(data, offsets[:-1][rows], 32)
        starts = offsets[:-1][rows] + np.arange(len(rows))
        if b - a > 1 or len(data) <= most:
            yield rows + a, data, starts, True
            continue
        start = 0
        while start < len(data):
            end, reach = len(data), most
            while start + reach < len(data):
                cuts = safe_cuts(data[start:start + reach], lines)
                if len(cuts):
                    end = start + int(cuts[-1])
                    break
                reach *= 2
            yield rows + a, data[start:end], np.zeros(1, np.int64), end == len(data)
            start = end


def merged_sets(*parts: np.ndarray) -> np.ndarray:
    """The distinct values of ascending arrays, ascending."""
    all_ = np.sort(np.concatenate(parts), kind="stable")
    return all_[np.append(True, all_[1:] != all_[:-1])] if len(all_) else all_


class Store:
    """Coded stretches: sizes, groups and links of each."""

    def __init__(self, both: "Pair"):
        self.both = both
        self._keep(np.zeros(0, np.int64), None)

    def _keep(self, at: np.ndarray, old: "Store | None") -> None:
        """Only the stretches at these places stay."""
        if old is None:
            self.place: dict[bytes, int] = {}
            self.size_a, self.size_b, self.groups, self.links, self.used = (np.zeros(0, np.int64) for _ in range(5))
            self.ok, self.said = np.zeros(0, bool), np.zeros(0, object)
            self.link_a, self.link_b, self.first = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int64)
            return
        keys = np.fromiter(self.place, object, len(self.place))[at]
        flat = ragged(self.first[at], self.links[at])
        self.link_a, self.link_b = self.link_a[flat], self.link_b[flat]
        for name in ("size_a", "size_b", "groups", "links", "ok", "said"):
            setattr(self, name, getattr(self, name)[at])
        self.first = np.cumsum(self.links) - self.links
        self.used = np.zeros(len(at), np.int64)
        self.place = dict(zip(keys.tolist(), range(len(at))))

    def places(self, stretches: list[bytes], times: np.ndarray) -> np.ndarray:
        """Place of each of these distinct stretches; new ones are coded. Places hold until the next call."""
        if len(self.place) > KEPT:
            self._keep(np.flatnonzero(self.used > 1), self)
        if len(self.place) > KEPT:  # all of them come again and again
            self._keep(np.zeros(0, np.int64), None)
        get = self.place.get
        at = np.fromiter((get(x, -1) for x in stretches), np.int64, len(stretches))
        new = np.flatnonzero(at < 0)
        if len(new):
            known = len(self.place)
            fresh = [stretches[i] for i in new.tolist()]
            self._add(fresh)
            at[new] = np.arange(known, known + len(new))
            self.place.update(zip(fresh, range(known, known + len(new))))
        self.used[at] += times
        return at

    def _add(self, stretches: list[bytes]) -> None:
        both, n = self.both, len(stretches)
        ids_a, ids_b = both.ids([x.decode() for x in stretches])
        size_a, size_b = (np.fromiter(map(len, x), np.int64, n) for x in (ids_a, ids_b))
        a, b = (np.fromiter(chain.from_iterable(x), np.int64, int(m.sum())) for x, m in ((ids_a, size_a), (ids_b, size_b)))
        width = np.fromiter(map(len, stretches), np.int64, n)
        off, raw = np.concatenate(([0], np.cumsum(width))), np.frombuffer(b"".join(stretches), np.uint8)
        ok = self._joined(both.table_a, a, size_a, off, raw) & self._joined(both.table_b, b, size_b, off, raw)
        # ends of tokens, for stretches whose bytes come back; the others' texts have no tokens
        keep_a, keep_b = np.repeat(ok, size_a), np.repeat(ok, size_b)
        size_a, size_b = size_a * ok, size_b * ok
        a, b = a[keep_a], b[keep_b]
        end_a, end_b = np.cumsum(both.table_a[1][a]), np.cumsum(both.table_b[1][b])
        ends = merged_sets(end_a, end_b)
        stretch_end = np.cumsum(width * ok)
        links = np.bincount(np.searchsorted(stretch_end, ends), minlength=n)
        at_a, at_b = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
        common = (end_a[at_a] == ends) & (end_b[at_b] == ends)
        groups = np.bincount(np.searchsorted(stretch_end, ends[common]), minlength=n)
        to_a, to_b = at_a[common] + 1, at_b[common] + 1
        text_a, text_b = list(map(str, a.tolist())), list(map(str, b.tolist()))
        said, i, j = [], 0, 0
        for x, y in zip(to_a.tolist(), to_b.tolist()):
            said.append(f"{text_a[i] if x - i == 1 else ','.join(text_a[i:x])}|{text_b[j] if y - j == 1 else ','.join(text_b[j:y])}")
            i, j = x, y
        to = np.cumsum(groups)
        joined = np.empty(n, object)
        joined[:] = [said[x] if y - x == 1 else ";".join(said[x:y]) for x, y in zip((to - groups).tolist(), to.tolist())]
        self.first = np.concatenate((self.first, len(self.link_a) + np.cumsum(links) - links))
        for name, more in (("size_a", size_a), ("size_b", size_b), ("groups", groups), ("links", links), ("used", np.zeros(n, np.int64)), ("ok", ok), ("said", joined),
                           ("link_a", a[at_a].astype(np.int32)), ("link_b", b[at_b].astype(np.int32))):
            setattr(self, name, np.concatenate((getattr(self, name), more)))

    @staticmethod
    def _joined(table: tuple, ids: np.ndarray, sizes: np.ndarray, off: np.ndarray, raw: np.ndarray) -> np.ndarray:
        """Whether the tokens' bytes are the stretch, for each stretch."""
        place, width, data = table
        each = width[ids]
        end = np.concatenate(([0], np.cumsum(each)))[np.concatenate(([0], np.cumsum(sizes)))]
        ok = np.diff(end) == np.diff(off)
        same = np.flatnonzero(ok)
        got = data[ragged(place[ids], each)]
        wrong = got[ragged(end[:-1][same], np.diff(end)[same])] != raw[ragged(off[:-1][same], np.diff(off)[same])]
        ok[np.repeat(same, np.diff(off)[same])[wrong]] = False
        return ok


class Coded:
    """The stretches of a part in order (seq: places in the worker's store) with the texts they are of."""

    def __init__(self, both: Pair, data: np.ndarray, starts: np.ndarray):
        begin = merged_sets(safe_cuts(data, both.lines), starts)
        made = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(np.append(begin, len(data))), pa.py_buffer(data.tobytes())]).dictionary_encode()
        local = made.indices.to_numpy(zero_copy_only=False)
        self.seq = both.store.places(made.dictionary.to_pylist(), np.bincount(local, minlength=len(made.dictionary)))[local]
        self.text_of = np.searchsorted(starts, begin, side="right") - 1
        for name in ("size_a", "size_b", "groups", "links", "ok", "said"):
            setattr(self, name, getattr(both.store, name))
        self.store = both.store


class Block:
    """Entries (pair, document, links) of some documents, and their bitmaps."""

    def __init__(self, name: int):
        self.name, self.docs, self.parts, self.entries = name, 0, [], 0

    def add(self, pairs: np.ndarray, place: np.ndarray, links: np.ndarray) -> None:
        self.parts.append((pairs, place, links))
        self.entries += len(pairs)

    def merged(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Entries by pair and document; a document's parts are one entry."""
        pairs, place, links = (np.concatenate(x) for x in zip(*self.parts))
        order = np.lexsort((place, pairs))
        pairs, place, links = pairs[order], place[order], links[order]
        new = np.flatnonzero(np.append(True, (np.diff(pairs) != 0) | (np.diff(place) != 0)))
        self.parts = [(pairs[new], place[new], np.add.reduceat(links, new))]
        self.entries = len(new)
        return self.parts[0]


def bitmaps(row: np.ndarray, place: np.ndarray, rows: int, width: int) -> pa.Array:
    """Compressed bitmaps of ``rows`` sorted sets of places: 16-bit places if they need less than ``width`` bytes, else ``width`` bytes of bits."""
    count = np.bincount(row, minlength=rows)
    dense = 2 * count >= width
    size = np.where(dense, width, 2 * count)
    end = np.cumsum(size)
    out = np.zeros(int(end[-1]) if rows else 0, np.uint8)
    thin = ~dense[row]
    at = np.repeat(end - size, count)[thin] + 2 * (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count))[thin]
    out[at], out[at + 1] = place[thin] & 255, place[thin] >> 8
    np.bitwise_or.at(out, (end - size)[row[~thin]] + (place[~thin] >> 3), (1 << (place[~thin] & 7)).astype(np.uint8))
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), rows, [None, pa.py_buffer(np.append(0, end)), pa.py_buffer(out.tobytes())]).cast(pa.binary())


def places(maps: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of all set places of compressed bitmaps."""
    off, data = text_bytes(maps.cast(pa.large_binary()))
    size = np.diff(off)
    dense = np.flatnonzero(size == width)
    thin = np.flatnonzero(size < width)
    two = data[ragged(off[:-1][thin], size[thin])].reshape(-1, 2).astype(np.int64)
    row, place = np.repeat(thin, size[thin] // 2), two[:, 0] | two[:, 1] << 8
    if len(dense):
        bits = np.unpackbits(data[ragged(off[:-1][dense], size[dense])].reshape(len(dense), width), axis=1, bitorder="little")
        which, at = np.nonzero(bits)
        row, place = np.concatenate((row, dense[which])), np.concatenate((place, at))
    return row, place


def postings_of(block: Block) -> pa.RecordBatch | None:
    if not block.parts:
        return None
    pairs, place, links = block.merged()
    new = np.append(True, np.diff(pairs) != 0)
    row, keys = np.cumsum(new) - 1, pairs[new]
    width = -(-block.docs // 8)
    more = links - 1
    planes, owners = [], []
    for k in range(int(more.max()).bit_length()):
        on = (more >> k) & 1 == 1
        planes.append(bitmaps(row[on], place[on], len(keys), width))
        owners.append(k)
    tall = np.zeros(len(keys), np.int64)  # planes of each pair
    np.maximum.at(tall, row, np.ceil(np.log2(more + 1)).astype(np.int64))
    flat = pa.concat_arrays(planes).take(pa.array(ragged(np.zeros(len(keys), np.int64), tall) * len(keys) + np.repeat(np.arange(len(keys)), tall))) if planes else pa.array([], pa.binary())
    lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(tall)).astype(np.int32)), flat)
    n = len(keys)
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, block.name)), pa.array((keys >> 32).astype(np.int32)), pa.array((keys & 0xFFFFFFFF).astype(np.int32)), pa.array(np.full(n, width, np.int32)),
                                       bitmaps(row, place, n, width), lists], names=["block", "a", "b", "width", "docs", "planes"])


DOC = [("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string())]
POSTING = [("a", pa.int32()), ("b", pa.int32()), ("width", pa.int32()), ("docs", pa.binary()), ("planes", pa.list_(pa.binary()))]


def _align(path_a: str, path_b: str):
    """For mapInArrow on (id, text): rows of documents (a is null) and rows of postings, in blocks of the task's documents."""

    def wide(block: np.ndarray, place, doc: pa.RecordBatch | None, posting: pa.RecordBatch | None, id_type: pa.DataType) -> pa.RecordBatch:
        n = len(block)
        cols = {"block": pa.array(block, pa.int64()), "place": pa.array(place, pa.int32()) if place is not None else pa.nulls(n, pa.int32())}
        for names, got in ((["id"], doc), ([k for k, _ in DOC], doc), ([k for k, _ in POSTING], posting)):
            for k in names:
                kind = id_type if k == "id" else dict(DOC + POSTING)[k]
                cols[k] = got.column(got.schema.get_field_index(k)).cast(kind) if got is not None else pa.nulls(n, kind)
        return pa.RecordBatch.from_pydict(cols)

    def run(batches):
        both = pair(path_a, path_b)
        task, made = TaskContext.get().partitionId(), 0
        block = Block(task << 32)
        for batch in (x.slice(at, BATCH_ROWS) for x in batches for at in range(0, len(x), BATCH_ROWS)):
            texts, ids = text_column(batch, "text"), batch.column(0)
            n = len(texts)
            where, place = np.empty(n, np.int64), np.empty(n, np.int32)
            n_a, n_b, groups, links = (np.zeros(n, np.int64) for _ in range(4))
            digest: list[str] = [""] * n
            given = 0

            def number(upto: int) -> None:
                """Rows before ``upto`` without a place get one in the open block."""
                nonlocal given
                where[given:upto], place[given:upto] = block.name, np.arange(block.docs, block.docs + upto - given)
                block.docs += upto - given
                given = max(given, upto)

            def full() -> Iterator[pa.RecordBatch]:
                nonlocal block, made
                if posted := postings_of(block):
                    for i in range(0, len(posted), 4096):
                        some = posted.slice(i, 4096)
                        yield wide(some.column(0).to_numpy(), None, None, some, ids.type)
                made += 1
                block = Block(task << 32 | made)

            running = None  # hash, whether anything was said, entries of a text that comes in parts
            for rows, data, starts, last in parts_of(texts, PART_BYTES, both.lines):
                fresh = running is None
                # documents of a part stand in one block: close it before, if they would not fit
                if fresh and (block.docs + int(rows[-1]) + 1 - given > BLOCK_DOCS or block.entries >= BLOCK_ENTRIES):
                    if block.docs + int(rows[0]) - given <= BLOCK_DOCS:
                        number(int(rows[0]))
                    yield from full()
                if fresh:
                    number(int(rows[-1]) + 1)
                coded = Coded(both, data, starts)
                bad = np.bincount(coded.text_of, weights=~coded.ok[coded.seq], minlength=len(rows)) > 0
                for out, of in ((n_a, coded.size_a), (n_b, coded.size_b), (groups, coded.groups), (links, coded.links)):
                    out[rows] += np.bincount(coded.text_of, weights=of[coded.seq], minlength=len(rows)).astype(np.int64)
                cut = np.searchsorted(coded.text_of, np.arange(len(rows) + 1))
                said = coded.said[coded.seq]
                if fresh and last:
                    for k, (row, x, y) in enumerate(zip(rows.tolist(), cut[:-1].tolist(), cut[1:].tolist())):
                        digest[row] = "" if bad[k] else hashlib.sha256(";".join(said[x:y].tolist()).encode()).hexdigest()
                else:
                    if fresh:
                        running = [hashlib.sha256(), False, []]
                    running[0].update((b";" if not fresh else b"") + ";".join(said.tolist()).encode())
                    running[1] |= bool(bad.any())
                # (stretch, text) -> links of each pair in each text
                per = np.sort(coded.text_of * len(coded.ok) + coded.seq)
                new = np.flatnonzero(np.append(True, per[1:] != per[:-1]))
                per, times = per[new], np.diff(np.append(new, len(per)))
                per, times = per[~bad[per // len(coded.ok)]], times[~bad[per // len(coded.ok)]]
                text, stretch = per // len(coded.ok), per % len(coded.ok)
                each = coded.links[stretch]
                flat = ragged(coded.store.first[stretch], each)
                pairs = coded.store.link_a[flat].astype(np.int64) << 32 | coded.store.link_b[flat]
                local, inverse = np.unique(pairs, return_inverse=True)
                key = np.repeat(text, each) * len(local) + inverse
                order = np.argsort(key, kind="stable")
                key, weight = key[order], np.repeat(times, each)[order]
                entry = None
                if len(key):
                    new = np.flatnonzero(np.append(True, np.diff(key) != 0))
                    entry = local[key[new] % len(local)], place[rows[key[new] // len(local)]].astype(np.int64), np.add.reduceat(weight, new)
                if running is not None:
                    if entry is not None:
                        running[2].append(entry)
                        if sum(len(x[0]) for x in running[2]) > BLOCK_ENTRIES:
                            own = Block(0)
                            own.parts = running[2]
                            running[2] = [own.merged()]
                    if last:
                        bad = np.array([running[1]])
                        digest[rows[0]] = "" if running[1] else running[0].hexdigest()
                        if not running[1]:
                            for x in running[2]:
                                block.add(*x)
                        running = None
                elif entry is not None:
                    block.add(*entry)
                if running is None:
                    for out in (n_a, n_b, groups, links):
                        out[rows[bad]] = 0
            if block.docs + n - given > BLOCK_DOCS:
                yield from full()
            number(n)
            made_rows = pa.RecordBatch.from_arrays([ids, pa.array(n_a), pa.array(n_b), pa.array(groups), pa.array(links), pa.array(digest, pa.string())], names=["id", *(k for k, _ in DOC)])
            yield wide(where, place, made_rows, None, ids.type)
        if block.parts:
            yield from full()

    return run


def pair_counts(postings: DataFrame) -> DataFrame:
    """(a, b, n_docs, n_links): how many documents hold the pair linked, and how often, by popcounts of bitmaps and planes."""
    ones = lambda m: F.when(F.octet_length(m) < F.col("width"), F.octet_length(m) / 2).otherwise(F.bitmap_count(m)).cast("bigint")
    planes = F.aggregate(F.transform("planes", lambda m, k: ones(m) * F.pow(F.lit(2.0), k).cast("bigint")), F.lit(0).cast("bigint"), lambda x, y: x + y)
    return postings.select("a", "b", ones(F.col("docs")).alias("d"), planes.alias("p")).groupBy("a", "b").agg(F.sum("d").alias("n_docs"), (F.sum("d") + F.sum("p")).alias("n_links"))


def _scored(docs: pa.Table, postings: pa.Table) -> pa.Table:
    """The documents of a block with n_best and count_sum from its postings."""
    n = int(docs["place"].to_numpy().max(initial=-1)) + 1
    best, total = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if len(postings) and n:
        width = postings["width"][0].as_py()
        count, top = postings["n_docs"].to_numpy(), postings["top"].to_numpy().astype(np.int64)
        docs_of = postings["docs"].combine_chunks()
        planes = postings["planes"].combine_chunks()
        owner = np.repeat(np.arange(len(planes)), np.diff(planes.offsets.to_numpy()))
        level = np.arange(len(owner)) - (planes.offsets.to_numpy()[:-1] - planes.offsets.to_numpy()[0])[owner]
        for maps, of, times in ((docs_of, np.arange(len(docs_of)), np.ones(len(docs_of), np.int64)), (planes.flatten(), owner, 1 << level)):
            row, place = places(maps, width)
            np.add.at(total, place, (count[of] * times)[row])
            np.add.at(best, place, (top[of] * times)[row])
    place = docs["place"].to_numpy()
    keep = docs.drop_columns(["block", "place"])
    return keep.append_column("n_best", pa.array(best[place])).append_column("count_sum", pa.array(total[place]))


def aligned(docs: DataFrame, path_a: str, path_b: str, id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents, postings) as tables of the shared folder; runs a job.

    documents: block, place, id, n_a, n_b, n_groups, n_links, groups_sha256; postings: block, a, b, width, docs, planes.
    """
    kind = docs.schema[id].dataType.simpleString()
    read = docs.select(docs[f"`{id}`"].alias("id"), docs[f"`{text}`"].cast("string").alias("text"))
    kinds = f"block bigint, place int, id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, a int, b int, width int, docs binary, planes array<binary>"
    made = written(read.mapInArrow(_align(path_a, path_b), kinds), "alignment")
    return (made.where("a is null").select("block", "place", "id", *(k for k, _ in DOC)),
            made.where("a is not null").select("block", *(k for k, _ in POSTING)))


def align(docs: DataFrame, path_a: str, path_b: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, n_a, n_b, n_groups, n_links, n_best (links whose pair has the highest document count of its A id, ties included), count_sum (document counts
    over links), groups_sha256 (of "a1,a2|b1;a3|b2,b3"). Runs a job.

    path_a: a byte-level BPE file of the tokenizers library; path_b: a sentencepiece model with dummy prefix, without other
    normalisation; other kinds are refused. Texts that are null or empty, or that B does not give back (a literal U+2581), have
    no tokens: zeros and ''. Every row is a document of its own, repeated rows and null ids too; texts are coded whole,
    long ones in parts; an empty table gives no rows; other columns are not read, so their names may clash.
    """
    made, postings = aligned(docs, path_a, path_b, id, text)
    counts = pair_counts(postings).select("a", "b", "n_docs")
    counts = counts.join(counts.groupBy("a").agg(F.max("n_docs").alias("most")), "a").select("a", "b", "n_docs", (F.col("n_docs") == F.col("most")).cast("int").alias("top"))
    scored = postings.join(counts, ["a", "b"]).select(F.col("block").alias("of_block"), "width", "docs", "planes", "n_docs", "top")
    kind = docs.schema[id].dataType.simpleString()
    kinds = f"id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, n_best bigint, count_sum bigint"
    return made.groupBy("block").cogroup(scored.groupBy("of_block")).applyInArrow(_scored, kinds).withColumnRenamed("id", id)
