"""Operators that look at each text alone, against the libraries or brute force."""

import re
import zlib

import sentencepiece
from hypothesis import given, settings, strategies as st
import numpy as np
import pyarrow as pa
import public_tokenizers
from tokenizers import Tokenizer

from cohortlens.llm import license_scan as lic, packing, pieces, token_counts as tc


ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "word"), (4, "word"), (None, "no id here"), (5, "Zoë's 日本 naïve 😀 test, it's\n\nfine "),
       (6, "la la la " * 3000), (7, "x" * 20000), (8, "the same text of seven plain words"), (9, "the same text of seven plain words")]  # as in conftest.py
BYTE, WORD, PIECE = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
TRICKY = st.text(st.sampled_from(list("  \n\t'strevlmdaA1²é日!?’ ßÍİΣ\x00́​▁_-😀")) | st.characters(exclude_categories=["Cs"]), max_size=40)
SPECIAL = st.lists(st.sampled_from(["<|endoftext|>", "<|startoftext|>", "a", " ", "'re", "word."]), max_size=6).map("".join)


def column(texts):
    return pa.array(texts, pa.large_string())


@settings(max_examples=60, deadline=None)
@given(st.lists(TRICKY | SPECIAL, max_size=20))
def test_token_counts_are_the_librarys(texts):
    library = Tokenizer.from_file(BYTE)
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert tc.count_texts(column(texts), BYTE).tolist() == want


def test_token_counts_across_chunks_and_recompiled_states(monkeypatch):
    text = "it's  the\n\n 12ab's'll ''re end " * 400
    library = Tokenizer.from_file(BYTE)
    want = [len(library.encode(t, add_special_tokens=False).ids) for t in (text, text[1:], text + "'l")]
    monkeypatch.setattr(tc, "MOST_STATES", 3)
    assert tc.count_texts(column([text, text[1:], text + "'l"]), BYTE).tolist() == want


def test_prefix_scan_composes_maps():
    maps = np.random.default_rng(1).integers(0, tc.N_STATES, (37, tc.N_STATES)).astype(np.uint8)
    got, state = tc.prefix_scan(maps), np.arange(tc.N_STATES)
    for i, m in enumerate(maps):
        state = m[state]
        assert (got[i] == state).all()


def test_token_counts_rows(odd_docs, no_docs):
    got = sorted(map(tuple, tc.token_counts(odd_docs, BYTE, keep=["doc_id"]).collect()), key=str)
    library = Tokenizer.from_file(BYTE)
    want = []
    for i, t in ODD:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 512))
    assert got == sorted(want, key=str)
    assert tc.token_counts(odd_docs.withColumnRenamed("score", "n_tokens"), BYTE).columns[-3:] == ["n_bytes", "n_tokens", "over_limit"]
    assert tc.token_counts(no_docs, BYTE).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(TRICKY | SPECIAL, max_size=20))
def test_pieces_are_the_librarys(texts):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    ids, sizes = pieces.encode_texts(column(texts), PIECE)
    want = library.encode(texts, num_threads=1) if texts else []
    ends = np.cumsum(sizes)
    assert [ids[e - n:e].tolist() for e, n in zip(ends, sizes)] == want
    assert pieces.decode_ids(ids, sizes, PIECE).to_pylist() == [library.decode(w) if w else "" for w in want]


def test_suffix_array_is_sorted():
    codes = np.random.default_rng(2).integers(0, 3, 500).astype(np.uint16)
    order, _ = pieces.suffix_array(codes, 4)
    key = lambda i: tuple(codes[i:i + 16]) + (0,) * (16 - len(codes[i:i + 16]))
    assert sorted(order.tolist()) == list(range(500)) and [key(i) for i in order] == sorted(key(i) for i in range(500))


def test_pieces_rows(spark, odd_docs, no_docs):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    want = [(i, len(ids := library.encode(t or "")), zlib.crc32(np.array(ids, "<u4").tobytes()), True) for i, t in ODD]
    assert sorted(map(tuple, pieces.round_trip(odd_docs, PIECE).collect()), key=str) == sorted(want, key=str)
    back = pieces.decode(pieces.encode(odd_docs, PIECE), PIECE).collect()
    assert sorted(map(tuple, back), key=str) == sorted(((i, t or "") for i, t in ODD), key=str)
    nulls = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert sorted(map(tuple, pieces.decode(nulls, PIECE).collect())) == [(1, None), (2, "")]
    assert pieces.round_trip(no_docs, PIECE).count() == 0


def scanned(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    at = [(i, label) for p, label in lic.BASE.items() for i in range(len(words)) if words[i:i + len(p.split())] == p.split()]
    starts = [i for i, _ in at]
    return len(words), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at}))


BASE_COLUMNS = ["n_words", "n_base", "first_word", "last_word", "base_labels"]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["cc", "BY", "-", " ", "\n", "general ", "Public", " license ", "all rights", " reserved", "é", "\x85", "0", "_", "SPDX-License-Identifier: MIT"]), max_size=25).map("".join), max_size=8))
def test_base_phrases(texts):
    got = pa.table(lic.scan(column(texts), lic.BASE, lic.NOTICES, lic.ALLOWED))
    assert [tuple(got[c][i].as_py() for c in BASE_COLUMNS) for i in range(len(texts))] == [scanned(t) for t in texts]


def test_expressions():
    ev = lambda s: (lambda e: e and (lic.licences_of(e), lic.permitted(e)))(lic.parse_expression(s))
    assert ev("MIT") == (["mit"], True)
    assert ev("GPL-2.0 OR MIT AND ISC") == (["gpl-2.0", "mit", "isc"], True)
    assert ev("(GPL-2.0 OR MIT) AND gpl-3.0") == (["gpl-2.0", "mit", "gpl-3.0"], False)
    assert ev("Apache-2.0 WITH LLVM-exception or isc") == (["apache-2.0-with-llvm-exception", "isc"], True)
    assert ev("GPL-2.0-or-later WITH Classpath-exception-2.0") == (["gpl-2.0-or-later-with-classpath-exception-2.0"], False)
    assert [ev(s) for s in ("", "or MIT", "(MIT", "()", "with x")] == [None] * 5
    assert lic.parse_expression("MIT AND") == ["mit"] and lic.parse_expression("((mit))") == ["mit"]
    assert ev("LicenseRef-Own.1 AND CC-BY-SA-4.0") == (["licenseref-own.1", "cc-by-sa-4.0"], False)


def test_words_of_prose_are_no_licences():
    """Neither after a tag nor after an operator; an operator that nothing known follows is prose too."""
    ev = lambda s: (lambda e: e and (lic.licences_of(e), lic.permitted(e)))(lic.parse_expression(s))
    assert ev("the file header") is None and ev("see COPYING") is None and ev("(more words)") is None
    assert ev("MIT and more words") == (["mit"], True) and ev("MIT or else") == (["mit"], True)
    assert ev("MIT with care") == (["mit"], True) and ev("Apache-2.0 with (x)") == (["apache-2.0"], True)
    texts = column(["SPDX-License-Identifier: the file header", "SPDX-License-Identifier: MIT and more words"])
    got = lic.scan(texts, lic.BASE, lic.NOTICES, lic.ALLOWED)
    assert got["labels"].to_pylist() == ["", "mit"] and got["score"].to_pylist() == [0.0, 1.0] and got["permitted"].to_pylist() == [None, True]


def test_many_hits_take_linear_time():
    import time

    def took(n):
        start = time.perf_counter()
        got = lic.scan(column(["all rights reserved word " * n]), lic.BASE, lic.NOTICES, lic.ALLOWED)
        assert got["n_base"][0].as_py() == n and got["last_word"][0].as_py() == 4 * (n - 1)
        return time.perf_counter() - start

    took(1000)
    assert took(80_000) < 30 * max(took(8_000), 0.01)


def test_license_rows(spark, odd_docs, no_docs):
    got = lic.license_scan(odd_docs).select("doc_id", *BASE_COLUMNS, "labels", "score", "permitted").collect()
    assert sorted(map(tuple, got), key=str) == sorted(((i, *scanned(t), "", 0.0, None) for i, t in ODD), key=str)
    tagged = spark.createDataFrame([(1, "// SPDX-License-Identifier: (MIT OR GPL-2.0-only)\nAll rights reserved. Apache License, Version 2.0")], "doc_id long, text string")
    row = lic.license_scan(tagged).first()
    assert row.labels == "apache,apache-2.0,gpl-2.0-only,mit,reserved" and row.base_labels == "reserved" and row.score == 1.0 and row.permitted and row.n_tags == 1
    assert ("all rights reserved", 9, 12) in [tuple(s) for s in row.spans]
    assert lic.license_scan(no_docs).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(TRICKY | SPECIAL, max_size=20))
def test_packed_ids_are_the_librarys(texts):
    library = Tokenizer.from_file(WORD)
    ids, ends = packing.token_ids(column(texts), WORD, 0)
    want = [e.ids + [0] for e in library.encode_batch(texts, add_special_tokens=False)]
    assert ids.tolist() == [i for w in want for i in w] and ends.tolist() == np.cumsum([len(w) for w in want]).tolist()


def test_other_kinds_are_refused(tmp_path):
    """A tokenizer that keeps white space is not packed; a model that normalises is not matched."""
    import pytest
    import sentencepiece as sp

    with pytest.raises(ValueError, match="white space"):
        packing.tokenizers_of(public_tokenizers.path("byte_bpe_50k.json"))
    assert packing.tokenizers_of(WORD)[0] is not None
    assert pieces.Vocabulary(public_tokenizers.path("piece_bpe_32k.model")).size == sp.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model")).get_piece_size()
