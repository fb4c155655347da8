"""The manifest against a plain recursive one, and what tampering does to it."""

import hashlib
import zlib

import pytest

from cohortlens.llm import merkle


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def climbed(hashes):
    """(root, [siblings of each leaf as (left, right)])"""
    paths, level, of = [[] for _ in hashes], list(hashes), [[i] for i in range(len(hashes))]
    while len(level) > 1:
        above, owners = [], []
        for a in range(0, len(level), 16):
            run = level[a:a + 16]
            for s in range(len(run)):
                for leaf in of[a + s]:
                    paths[leaf].append(("".join(run[:s]), "".join(run[s + 1:])))
            above.append(digest(*run))
            owners.append([x for o in of[a:a + 16] for x in o])
        level, of = above, owners
    return (level or [None])[0], paths


def plain(rows):
    trees = {}
    for r in rows:
        i, text, lang, source, n = r[:5]
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text) if text is not None else None
        leaf, bad = (digest(*map(field, (i, source, lang, n, t))) for t in (text, low))
        hit = i is not None and zlib.crc32(str(i).encode()) % 5 == 0
        trees.setdefault(source, []).append((i is not None, i or 0, leaf, i, bad if hit else leaf))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    made = {}
    for s in order:
        trees[s].sort()
        made[s] = climbed([x[2] for x in trees[s]])
    root, top = climbed([made[s][0] for s in order])
    out = []
    for s, above in zip(order, top):
        for (_, _, leaf, i, used), path in zip(trees[s], made[s][1]):
            h = used
            for left, right in path + above:
                h = digest(left, h, right)
            out.append((i, leaf, made[s][0], root, digest(*(a + b for a, b in path + above)), h, h == root))
    return sorted(out, key=str)


NAMES = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def check(docs, rows):
    got = sorted([tuple(r[c] for c in NAMES) for r in merkle.verified(merkle.manifest(docs)).collect()], key=str)
    assert got == plain(rows)
    return got


KINDS = "doc_id long, text string, lang string, source string, n_chars long, leaf string, i string"


def test_manifest(spark):
    """A lone leaf, a full run, a run of one, three levels; null ids, sources and texts; repeated rows; clashing names."""
    rows = [(i, f"Text {i} ÄB" if i % 7 else None, "en" if i % 3 else None, "big", i if i % 4 else None) for i in range(273)]
    rows += [(1000 + i, f"Of {i}", "de", "run", 3) for i in range(17)] + [(5, "alone É", "fr", "one", 1), (6, "", None, None, None), (7, "B", None, None, 0)]
    rows += [(None, "No id", "en", "big", 1)] * 3 + [(8, "Twice", "en", "run", 1)] * 40 + [(9, "z" * 100000 + "Q", "en", "ü", 2), (-4, "Minus", "en", "Z", 2)]
    got = check(spark.createDataFrame([(*r, "x", "y") for r in rows], KINDS).repartition(5), rows)
    assert {v for *_, v in got} == {True, False}


def test_many_sources(spark):
    rows = [(i, f"T{i}", "en", f"s{i % 40}", i) for i in range(90)]
    check(spark.createDataFrame([(*r, None, None) for r in rows], KINDS), rows)


@pytest.mark.parametrize("rows", [[], [(5, "One", "en", "s", 1)], [(None, None, None, None, None)]])
def test_small(spark, rows):
    check(spark.createDataFrame([(*r, None, None) for r in rows], KINDS), rows)


def test_one_source_row_untouched_by_case(spark):
    """Where nothing is upper case, tampering changes nothing."""
    rows = [(i, "lower", None, "s", 1) for i in range(50)]
    got = check(spark.createDataFrame([(*r, None, None) for r in rows], KINDS), rows)
    assert all(r[-1] for r in got)
