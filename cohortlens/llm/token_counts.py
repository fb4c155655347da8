"""Token counts of whole texts by a tokenizer compiled to finite-state transducers.

A byte-level BPE tokenizer is two machines in a row, and neither needs the merge loop at run time.

* The splitter cuts a text into pieces (words with their leading space, numbers, signs, runs of space, English
  contractions). It is a deterministic transducer of twelve states over eleven character classes; its transitions say
  whether a piece starts before this or the previous character. Texts are laid end to end with an end mark, which resets
  the machine, and cut into chunks of equal length. Each chunk's state map (start state -> end state) is found for all
  chunks side by side; the maps are composed by a parallel prefix scan, which gives every chunk its true start state,
  and a second pass emits the starts.
* The counter reads a piece's bytes. A tokenization is the BPE one exactly when each two neighbours are what BPE makes of
  their joined bytes, so the last token of every prefix is determined by earlier last tokens. The state holds, for each
  earlier cut from which a vocabulary entry may still reach further, the vocabulary-trie node, the last token before the
  cut and how many tokens lie between; a transition is annotated with the change of the token count. States are
  determinised when first met and kept, so they follow the vocabulary and the words, not the amount of text.

Equal pieces of a slice are counted once. Special strings inside a text are one token each, as the library's default.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from .common import per_text, text_bytes

#: Compiled states kept by a worker; beyond it the table is dropped and compiled anew. Results do not depend on it.
MOST_STATES = 250_000
CHUNK = 512
#: Steps after which chunks whose state map is constant go on with one lane.
SETTLE = 16

# --- the splitter ---------------------------------------------------------------------------------

END, SPACE, WS, NUM, SIGN, APOS, LETTER, STMD, CR, CV, CE, CL = range(12)
N_CLASSES = 12
FRESH, IN_L, IN_N, IN_P, SP1, WS1, SPN, WSN, AP, AP_R, AP_V, AP_L = range(12)
N_STATES = 12
BEFORE, BEFORE_LAST = 1, 2


def _splitter() -> tuple[np.ndarray, np.ndarray]:
    """(next state, emission) by state * N_CLASSES + class."""
    letters = (LETTER, STMD, CR, CV, CE, CL)
    fresh = {END: FRESH, SPACE: SP1, WS: WS1, NUM: IN_N, SIGN: IN_P, APOS: AP} | dict.fromkeys(letters, IN_L)
    to, out = np.zeros((N_STATES, N_CLASSES), np.uint8), np.zeros((N_STATES, N_CLASSES), np.uint8)
    for c in range(N_CLASSES):
        for s in range(N_STATES):
            nxt, emit = fresh[c], BEFORE
            attach = {**dict.fromkeys(letters, IN_L), NUM: IN_N, SIGN: IN_P, APOS: IN_P}.get(c)
            if s == IN_L and c in letters or s == IN_N and c == NUM or s == IN_P and c in (SIGN, APOS):
                nxt, emit = s, 0
            elif s in (SP1, WS1, SPN, WSN) and c in (SPACE, WS):
                nxt, emit = SPN if c == SPACE else WSN, 0
            elif s in (SP1, SPN) and attach is not None:  # the last space goes with what follows
                nxt, emit = attach, BEFORE_LAST if s == SPN else 0
            elif s == WSN and c != END:  # the last of the white space stands alone
                emit = BEFORE | BEFORE_LAST
            elif s == AP:
                if c == STMD:
                    nxt, emit = FRESH, 0
                elif c in (CR, CV, CL):
                    nxt, emit = {CR: AP_R, CV: AP_V, CL: AP_L}[c], 0
                elif c in (SIGN, APOS):
                    nxt, emit = IN_P, 0
            elif s in (AP_R, AP_V, AP_L):
                if c == (CL if s == AP_L else CE):
                    nxt, emit = FRESH, 0
                elif c in letters:
                    nxt, emit = IN_L, BEFORE_LAST
                else:
                    emit = BEFORE | BEFORE_LAST
            if c == END:
                emit |= BEFORE
            to[s, c], out[s, c] = nxt, emit
    return to.ravel(), out.ravel()


@lru_cache(1)
def _char_classes() -> np.ndarray:
    """Class of every code point."""
    table = np.full(0x110000, SIGN, np.uint8)
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    for kind, pattern in ((NUM, r"\p{N}+"), (LETTER, r"\p{L}+"), (WS, r"\s+")):
        for m in regex.finditer(pattern, every):
            a, b = (x + 0x800 * (x >= 0xD800) for x in m.span())
            table[a:b] = kind
    table[0x20], table[0x27] = SPACE, APOS
    for kind, chars in ((STMD, "stmd"), (CR, "r"), (CV, "v"), (CE, "e"), (CL, "l")):
        table[[ord(x) for x in chars]] = kind
    return table


def chunk_maps(classes: np.ndarray, to: np.ndarray) -> np.ndarray:
    """(chunks, states): end state of each chunk for each start state. classes: (CHUNK, chunks)."""
    n = classes.shape[1]
    state = np.repeat(np.arange(N_STATES, dtype=np.uint8)[:, None], n, axis=1)
    for row in classes[:SETTLE]:
        state = to[state * np.uint8(N_CLASSES) + row]
    open_ = np.flatnonzero((state != state[0]).any(axis=0))
    rest = state[:, open_]
    one = state[0]
    for row in classes[SETTLE:]:
        one = to[one * np.uint8(N_CLASSES) + row]
        if len(open_):
            rest = to[rest * np.uint8(N_CLASSES) + row[open_]]
    state = np.repeat(one[None, :], N_STATES, axis=0)
    state[:, open_] = rest
    return state.T


def prefix_scan(maps: np.ndarray) -> np.ndarray:
    """Inclusive scan of the maps' compositions in log2(chunks) parallel steps."""
    out, step = maps.copy(), 1
    while step < len(out):
        out[step:] = np.take_along_axis(out[step:], out[:-step].copy(), axis=1)
        step *= 2
    return out


def piece_starts(classes: np.ndarray) -> np.ndarray:
    """Mask of the characters at which a piece starts (every END too), for classes that end with END."""
    to, out = _splitter()
    n = len(classes)
    chunks = -(-n // CHUNK)
    table = np.full(chunks * CHUNK, END, np.uint8)
    table[:n] = classes
    table = np.ascontiguousarray(table.reshape(chunks, CHUNK).T)
    scanned = prefix_scan(chunk_maps(table, to))
    state = np.full(chunks, FRESH, np.uint8)
    state[1:] = scanned[:-1, FRESH]
    emitted = np.empty((CHUNK, chunks), np.uint8)
    for i, row in enumerate(table):
        at = state * np.uint8(N_CLASSES) + row
        emitted[i] = out[at]
        state = to[at]
    emitted = emitted.T.reshape(-1)[:n]
    starts = (emitted & BEFORE) > 0
    starts[:-1] |= (emitted[1:] & BEFORE_LAST) > 0
    return starts


def split_pieces(offsets: np.ndarray, data: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """(pieces of all texts in order, number of pieces of each text)."""
    raw = data.tobytes()
    points = np.frombuffer(raw.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    first = np.flatnonzero((data & 0xC0) != 0x80)  # byte at which each character starts
    if len(first) != len(points):
        raise ValueError("texts must be valid UTF-8")
    ends = np.searchsorted(first, offsets[1:])
    classes = np.insert(_char_classes()[points], ends, END)
    starts = piece_starts(classes)
    is_end = np.zeros(len(classes), bool)
    is_end[ends + np.arange(len(ends))] = True
    kept = (starts & ~is_end)
    per_text_counts = np.diff(np.concatenate(([0], np.cumsum(kept)[is_end])))
    at = first[np.flatnonzero(kept[~is_end])]
    bounds = np.append(at, len(raw)).astype(np.int64)
    pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(bounds), pa.py_buffer(raw)])
    return pieces, per_text_counts


# --- the counter ----------------------------------------------------------------------------------

def _byte_of_symbol() -> dict[str, int]:
    """The byte each vocabulary symbol stands for: printable bytes are themselves, the others are numbered from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Counter:
    """Transducer from the bytes of a piece to its number of tokens; states are built when first met."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, symbol = spec["model"]["vocab"], _byte_of_symbol()
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.bytes_of = {i: bytes(symbol[c] for c in t) for t, i in vocab.items() if t not in self.special}
        self.single = [0] * 256
        self.children: list[dict[int, int]] = [{}]
        self.token_at: list[int] = [-1]
        for i, piece in self.bytes_of.items():
            node = 0
            for b in piece:
                if b not in self.children[node]:
                    self.children[node][b] = len(self.children)
                    self.children.append({})
                    self.token_at.append(-1)
                node = self.children[node][b]
            self.token_at[node] = i
            if len(piece) == 1:
                self.single[piece[0]] = i
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.merge = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.neighbours: dict[tuple[int, int], bool] = {}
        self._clear()

    def _clear(self) -> None:
        start = ((0, -1, 0),)
        self.ids, self.states, self.next, self.change = {start: 0}, [start], {}, {}
        self.neighbours.clear()

    def _merged(self, piece: bytes) -> list[int]:
        seq = [self.single[b] for b in piece]
        while len(seq) > 1:
            found = min((self.merge[p] for p in zip(seq, seq[1:]) if p in self.merge), default=None)
            if found is None:
                break
            out: list[int] = []
            for t in seq:  # leftmost first, as the merge loop goes
                if out and self.merge.get((out[-1], t)) == found:
                    out[-1] = found[1]
                else:
                    out.append(t)
            seq = out
        return seq

    def _can_meet(self, a: int, b: int) -> bool:
        got = self.neighbours.get((a, b))
        if got is None:
            got = self.neighbours[a, b] = self._merged(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return got

    def _compile(self, state: int, byte: int) -> None:
        live, new = [], None
        for node, last, count in self.states[state]:
            node = self.children[node].get(byte)
            if node is None:
                continue
            token = self.token_at[node]
            if new is None and token >= 0 and (last < 0 or self._can_meet(last, token)):
                new = token, count + 1
            if self.children[node]:
                live.append((node, last, count))
        token, change = new
        key = (*((n, t, c - change) for n, t, c in live), (0, token, 0))
        to = self.ids.get(key)
        if to is None:
            to = self.ids[key] = len(self.states)
            self.states.append(key)
        self.next[state << 8 | byte], self.change[state << 8 | byte] = to, change

    def count(self, pieces: list[bytes]) -> np.ndarray:
        if len(self.states) > MOST_STATES:
            self._clear()
        counts, nxt, change = np.zeros(len(pieces), np.int64), self.next, self.change
        for i, piece in enumerate(pieces):
            state = total = 0
            for b in piece:
                key = state << 8 | b
                to = nxt.get(key)
                if to is None:
                    self._compile(state, b)
                    to = nxt[key]
                total += change[key]
                state = to
            counts[i] = total
        return counts


@lru_cache(2)
def counter(path: str) -> Counter:
    """One compiled tokenizer per worker and file."""
    return Counter(path)


def count_texts(texts: pa.Array, path: str) -> np.ndarray:
    """Number of tokens of each text of a non-null large_string array."""
    machine = counter(path)
    offsets, data = text_bytes(texts)
    owner, specials = None, None
    raw = data.tobytes()
    if any(s.encode() in raw for s in machine.special):
        cut = regex.compile("|".join(map(regex.escape, sorted(machine.special, key=len, reverse=True))))
        parts = [cut.split(t) for t in texts.to_pylist()]
        owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        specials = np.array([len(p) - 1 for p in parts])
        offsets, data = text_bytes(pa.array([x for p in parts for x in p], pa.large_string()))
    pieces, per = split_pieces(offsets, data)
    coded = pieces.dictionary_encode()
    each = machine.count(coded.dictionary.to_pylist())
    sums = np.concatenate(([0], np.cumsum(each[coded.indices.to_numpy(zero_copy_only=False)] if len(pieces) else np.zeros(0, np.int64))))
    ends = np.cumsum(per)
    out = sums[ends] - sums[ends - per]
    return out if owner is None else np.bincount(owner, out, minlength=len(specials)).astype(np.int64) + specials


def token_counts(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None, limit: int = 512) -> DataFrame:
    """Columns ``keep`` (default: all but the text), n_bytes, n_tokens, over_limit (n_tokens > limit) for every row.

    path: a byte-level BPE file in the tokenizers library's format, readable on the executors. A null or empty text has
    0 bytes and 0 tokens. Rows are never dropped, repeated rows are counted each, texts of any length whole; columns named
    like a result are left out; an empty table gives no rows.
    One scan, no shuffle; a task holds one slice of texts and the compiled states.
    """
    made = [("n_bytes", pa.int64()), ("n_tokens", pa.int64())]
    names = {"n_bytes", "n_tokens", "over_limit"}
    keep = [c for c in (keep if keep is not None else docs.columns) if c != text and c.lower() not in names]

    def fn(texts: pa.Array) -> dict[str, pa.Array]:
        offsets, _ = text_bytes(texts)
        return {"n_bytes": pa.array(np.diff(offsets)), "n_tokens": pa.array(count_texts(texts, path))}

    kinds = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "n_bytes bigint", "n_tokens bigint"])
    out = docs.select(*keep, F.col(text).cast("string").alias(text)).mapInArrow(per_text(fn, text, keep, made), kinds)
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
