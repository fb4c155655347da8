"""Two tokenizers aligned, against a plain token-by-token search."""

import hashlib
from collections import Counter

import pytest
import sentencepiece
import tokenizers

from cohortlens.llm import alignment

ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "word"), (4, "word"), (None, "no id here"), (5, "Zoë's 日本 naïve 😀 test, it's\n\nfine "),
       (6, "la la la " * 3000), (7, "x" * 20000), (8, "the same text of seven plain words"), (9, "the same text of seven plain words")]

HARD = [(20, "▁ literal"), (21, "<|endoftext|> plain </s> text"), (22, " "), (23, "　a b  c  d\x85 e"), (24, "l'été où j'ai été là-bas"),
        (25, "a  b\n c \t d"), (26, "a\0b"), (27, "日本語の 文 " * 50), (28, "ﬁ ½ Å"), (29, "it's we'll​ x"), (30, "word word word word other")]


def searched(rows, path_a, path_b):
    a = tokenizers.Tokenizer.from_file(path_a)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=path_b)
    symbols = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(x): x for x in symbols} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in symbols)}
    out, links = [], []
    for i, text in rows:
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        raw_a = [bytes(byte[c] for c in a.id_to_token(x)) for x in ids_a]
        raw_b = [bytes([int(b.id_to_piece(x)[3:5], 16)]) if b.is_byte(x) else b.id_to_piece(x).replace("▁", " ").encode() for x in ids_b]
        if not text or {b"".join(raw_a), b"".join(raw_b)} != {(" " + text).encode()}:
            out.append([i, 0, 0, 0, 0, ""])
            links.append(Counter())
            continue
        span = lambda raw: [(sum(map(len, raw[:k])), sum(map(len, raw[:k + 1]))) for k in range(len(raw))] if len(raw) < 300 else list(zip([0, *sums(raw)], sums(raw)))
        at_a, at_b = span(raw_a), span(raw_b)
        found, j0 = Counter(), 0
        for (x, y), p in zip(at_a, ids_a):
            while at_b[j0][1] <= x:
                j0 += 1
            j = j0
            while j < len(at_b) and at_b[j][0] < y:
                found[p, ids_b[j]] += 1
                j += 1
        both = sorted({y for _, y in at_a} & {y for _, y in at_b})
        parts, start, ka, kb = [], 0, 0, 0
        for end in both:
            ga, gb = [], []
            while ka < len(at_a) and at_a[ka][1] <= end:
                ga.append(str(ids_a[ka]))
                ka += 1
            while kb < len(at_b) and at_b[kb][1] <= end:
                gb.append(str(ids_b[kb]))
                kb += 1
            parts.append(",".join(ga) + "|" + ",".join(gb))
        out.append([i, len(ids_a), len(ids_b), len(both), sum(found.values()), hashlib.sha256(";".join(parts).encode()).hexdigest()])
        links.append(found)
    count = Counter(p for found in links for p in found)
    most = {}
    for (p, _), c in count.items():
        most[p] = max(most.get(p, 0), c)
    return sorted([(*row, sum(m for p, m in found.items() if count[p] == most[p[0]]), sum(m * count[p] for p, m in found.items())) for row, found in zip(out, links)], key=str), count, links


def sums(raw):
    out, total = [], 0
    for x in raw:
        total += len(x)
        out.append(total)
    return out


@pytest.fixture
def paths(tokenizer_path):
    return tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")


NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]


def test_alignment(spark, paths, odd_docs, no_docs):
    extra = spark.createDataFrame([(i, t, None, "s", 0, "k", 0.0) for i, t in HARD], odd_docs.schema)
    docs = odd_docs.unionByName(extra).withColumnRenamed("id", "block").withColumnRenamed("score", "n_a")
    want, _, _ = searched(ODD + HARD, *paths)
    got = alignment.align(docs, *paths)
    assert sorted([tuple(r[c] for c in NAMES) for r in got.collect()], key=str) == want
    assert alignment.align(no_docs, *paths).count() == 0
    assert alignment.align(odd_docs.where("text is null"), *paths).select("n_a", "groups_sha256").first() == (0, "")


def test_parts_and_blocks(spark, paths, odd_docs, monkeypatch):
    """Long texts in parts, several blocks, dense and thin bitmaps: the same rows."""
    rows = ODD + HARD + [(100 + i, f"word number {i} of the same words " * (1 + i % 5)) for i in range(60)]
    want, count, links = searched(rows, *paths)
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    for name, value in (("PART_BYTES", 700), ("BLOCK_ENTRIES", 300), ("BLOCK_DOCS", 40), ("BATCH_ROWS", 7)):
        monkeypatch.setattr(alignment, name, value)
    made, postings = alignment.aligned(docs, *paths)
    assert made.select("block").distinct().count() > 2
    pairs = {(r.a, r.b): (r.n_docs, r.n_links) for r in alignment.pair_counts(postings).collect()}
    assert pairs == {p: (count[p], sum(x[p] for x in links)) for p in count}
    got = alignment.align(docs, *paths)
    assert sorted([tuple(r[c] for c in NAMES) for r in got.collect()], key=str) == want


def test_bitmaps():
    import numpy as np

    rng = np.random.default_rng(1)
    sets = [np.sort(rng.choice(500, size, replace=False)) for size in (0, 1, 10, 31, 32, 400)]
    row, place = np.repeat(np.arange(6), [len(s) for s in sets]), np.concatenate(sets)
    maps = alignment.bitmaps(row, place, 6, 63)
    assert [len(x.as_py()) for x in maps] == [0, 2, 20, 62, 63, 63]
    r, p = alignment.places(maps, 63)
    assert sorted(zip(r.tolist(), p.tolist())) == sorted(zip(row.tolist(), place.tolist()))


def test_other_kinds_are_refused(tokenizer_path):
    with pytest.raises(ValueError, match="byte-level"):
        alignment.Pair(tokenizer_path("word_bpe_49k.json"), tokenizer_path("piece_bpe_32k.model"))
