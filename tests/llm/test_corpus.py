"""Operators over whole tables, against brute force."""

import collections
import hashlib
import base64
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cohortlens.llm import language_id as lid, lm_score, near_dedup as nd, packing, quality_rules as qr, topk_join, warc

FOLDER = "/root/testdata/sf0.001"
KIND = "doc_id long, text string"


# --- near duplicates ------------------------------------------------------------------------------

def linked(rows, n, threshold):
    """(id, size, component) by comparing all pairs."""
    sets = [(i, nd.shingle_set(t, n)) for i, t in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, x), (b, y) in itertools.combinations([s for s in sets if s[0] is not None], 2):
        if x and y and 100 * len(x & y) >= threshold * len(x | y):
            ra, rb = sorted((root(a), root(b)))
            parent[rb] = ra
    return sorted([(i, len(s), None if i is None and s else root(i) if i is not None else None) for i, s in sets], key=str)


def copies(seed, groups, size, words, edits):
    rng, out = random.Random(seed), []
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 5))) for _ in range(300)]
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(words)]
        for _ in range(size):
            text = list(base)
            for _ in range(rng.randint(0, edits)):
                text[rng.randrange(words)] = rng.choice(vocabulary)
            out.append(" ".join(text))
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("rows,n", [(copies(1, 12, 12, 60, 9), 2), (copies(2, 2, 120, 40, 5), 2), (copies(3, 10, 10, 80, 4), 5)])
def test_near_duplicates(spark, rows, n):
    got = nd.near_duplicates(spark.createDataFrame(rows, KIND), n=n).collect()
    assert sorted([tuple(r)[:3] for r in got], key=str) == linked(rows, n, 80)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_odd(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = nd.near_duplicates(odd_docs, n=2).collect()
    assert sorted([tuple(r)[:3] for r in got], key=str) == linked(rows, 2, 80)
    assert next(r for r in got if r.doc_id is None).kept
    assert nd.near_duplicates(no_docs, n=2).count() == 0
    # rows of one id with different texts tie their groups together
    tied = [(1, "a b c d"), (2, "a b c d"), (2, "w x y z"), (3, "w x y z"), (4, "q r s t")]
    assert sorted(tuple(r)[::2] for r in nd.near_duplicates(spark.createDataFrame(tied, KIND), n=2).select("doc_id", "n_shingles", "component_id").collect()) == [(1, 1), (2, 1), (2, 1), (3, 1), (4, 4)]


def test_signature_is_circulant():
    windows = nd.rank_windows(8)
    assert (windows[5][1:] == windows[6][:-1]).all() and (windows[nd.CELLS - 1][1:] == windows[0][:-1]).all()


def test_components(spark):
    chain = [(i + 1, i) for i in range(40)] + [(100, 101), (102, 101)]
    got = dict(map(tuple, nd.components(spark.createDataFrame(chain, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}


# --- packing --------------------------------------------------------------------------------------

def fewest(items, capacity):
    """Optimal number of sequences by search."""
    best = len(items)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(items):
            best = len(rooms)
            return
        for j in range(len(rooms)):
            if rooms[j] >= items[i] and rooms[j] not in rooms[:j]:
                rooms[j] -= items[i]
                go(i + 1, rooms)
                rooms[j] += items[i]
        go(i + 1, [*rooms, capacity - items[i]])

    go(0, [])
    return best


def test_reduction_keeps_the_optimum():
    rng = random.Random(4)
    for _ in range(150):
        capacity = rng.choice([10, 17, 30])
        items = sorted((rng.randint(1, capacity) for _ in range(rng.randint(1, 9))), reverse=True)
        lengths = packing.Lengths(dict(collections.Counter(items)))
        fixed = packing.reduce_by_dominance(lengths, capacity)
        assert all(sum(s * k for s, k in p) <= capacity for _, p in fixed)
        rest = [s for s, n in lengths.count.items() for _ in range(n)]
        assert sum(n for n, _ in fixed) + fewest(sorted(rest, reverse=True), capacity) == fewest(items, capacity)


def test_plan_places_all():
    rng = random.Random(5)
    for _ in range(50):
        counts = collections.Counter(rng.randint(1, 50) for _ in range(rng.randint(0, 80)))
        table = packing.plan(dict(counts), 50)
        total = sum(s * n for s, n in counts.items())
        assert -(-total // 50) <= table["sequences"] <= max(1, 1.25 * total / 50 + 1)


def test_pack(spark, odd_docs, no_docs, tokenizer_path):
    path = tokenizer_path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    want = []
    for r in odd_docs.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids + [0]
        for piece, start in enumerate(range(0, len(ids), 64)):
            part = ids[start:start + 64]
            want.append((r.doc_id, piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), tuple(part)))
    got = packing.pack(odd_docs, path, capacity=64, with_ids=True).collect()
    assert sorted([(*tuple(r)[:5], tuple(r.ids)) for r in got], key=str) == sorted(want, key=str)
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        places.sort()
        assert [a for a, _ in places] == [sum(n for _, n in places[:i]) for i in range(len(places))] and sum(n for _, n in places) <= 64
    assert len(by) == -(-sum(r.length for r in got) // 64)
    assert packing.pack(no_docs, path).count() == 0


# --- language -------------------------------------------------------------------------------------

def test_languages_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = lid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(held) > 200 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.97 and all(0 <= r.score <= 1 for r in got)


def test_languages_odd(spark, odd_docs, no_docs):
    got = {(r.doc_id, r.lang_pred == "und", r.score > 0) for r in lid.identify(odd_docs).collect()}
    assert {g for g in got if g[1]} == {(1, True, False), (2, True, False), (3, True, False)} and all(g[1] != g[2] for g in got)
    assert lid.identify(no_docs).count() == 0
    assert {r.lang_pred for r in lid.identify(odd_docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    kept = lid.identify(odd_docs, all_columns=True, prefix="p_")
    assert kept.columns[:7] == odd_docs.columns and kept.count() == odd_docs.count()


def test_codewords():
    for k in (2, 3, 4, 5, 6, 17, 40):
        code = lid.codewords(k)
        apart = [(a != b).sum() for a, b in itertools.combinations(code, 2)]
        assert code.shape[0] == k and min(apart) >= max(1, code.shape[1] // 4) and all(abs(c.sum()) < k for c in code.T)


# --- quality --------------------------------------------------------------------------------------

def measured(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = collections.Counter(zip(words, words[1:], words[2:]))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_metrics(spark, odd_docs, no_docs, monkeypatch):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    for table in (docs, odd_docs):
        want = sorted([(r.doc_id, *measured(r.text)) for r in table.select("doc_id", "text").collect()], key=str)
        got = qr.judge(table, labels).collect()
        assert sorted([tuple(r)[:6] for r in got], key=str) == want
        assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in got) and not any(r.kept and r.base_failed for r in got)
    monkeypatch.setattr(qr, "PLACE", 60)  # four bits of hash: windows clash and are told apart by their words
    got = qr.judge(docs, labels).collect()
    assert sorted(tuple(r)[:6] for r in got) == sorted((r.doc_id, *measured(r.text)) for r in docs.collect())
    assert qr.judge(no_docs, labels).count() == 0


def test_binomial_tail(spark):
    cases = [(0, 1), (0, 900), (3, 900), (8, 900), (40, 9000), (9, 900), (700, 900)]
    df = spark.createDataFrame(cases, "k long, n long")
    got = [r[0] for r in df.select(qr.binomial_tail(df.k, df.n, 0.01)).collect()]
    for (k, n), p in zip(cases, got):
        exact = sum(math.comb(n, i) * 0.01 ** i * 0.99 ** (n - i) for i in range(k + 1)) if k < 0.01 * n else 1.0
        assert p == pytest.approx(exact, rel=1e-9)


def test_cutoffs_keep_the_guarantee(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(5))
    rows, labels = [], []
    for i in range(3000):
        bad = i % 10 == 0
        rows.append((i, " ".join(word() + ("##" if bad else "#" if i % 977 == 1 else "") for _ in range(60)), "s" if i % 5 else None))
        labels.append((i, 0 if bad else 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    lab = spark.createDataFrame([*labels, (5, None), (None, 1), (7, 1)], "doc_id long, quality int")
    got = {r.doc_id: r for r in qr.judge(docs, lab, alpha=0.1).collect()}
    assert all(not got[i].kept for i in range(0, 3000, 10) if i % 5)
    assert all(r.rejected_by in ([], ["symbols"]) for r in got.values())
    false = [i for i, q in labels if q and not got[i].kept]
    assert len(false) <= 0.02 * 2700
    assert all(r.kept for r in qr.judge(docs, lab.limit(0)).collect())


# --- language model -------------------------------------------------------------------------------

def backoff(rows, order, alpha, own):
    texts = [re.sub(rb"[\x20\x09-\x0d]+", b" ", (t or "").encode()).lower() for _, t in rows]
    count = collections.Counter(x[i:i + k] for x in texts for k in range(1, order + 1) for i in range(len(x) - k + 1))
    total = sum(map(len, texts))

    def score(g):
        if len(g) == 1:
            return math.log(max(count[g] - own, 0.5) / max(total - own, 1))
        if count[g] > own:
            return math.log((count[g] - own) / max(count[g[:-1]] - own, 1))
        return math.log(alpha) + score(g[1:])

    return [(i, len(x), round(sum(score(x[max(0, j - order + 1):j + 1]) for j in range(len(x))), 6)) for (i, _), x in zip(rows, texts)]


@pytest.mark.parametrize("order,own", [(1, True), (3, False), (5, True)])
def test_lm_scores(spark, odd_docs, order, own, monkeypatch):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = lm_score.scores(odd_docs.repartition(3), order=order, leave_one_out=own).collect()
    assert sorted([(r.doc_id, r.n_scored, round(r.log_score, 6)) for r in got], key=str) == sorted(backoff(rows, order, 0.4, own), key=str)
    assert all((r.mean_log_score is None) == (r.n_scored == 0) for r in got)


def test_lm_empty(no_docs):
    assert lm_score.scores(no_docs).count() == 0


# --- search ---------------------------------------------------------------------------------------

def searched(rows, asked, k):
    good = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v)
    rows = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and good(v)]
    out = []
    for q, v in {i: v for i, v in rows if asked(i)}.items():
        found = sorted(((-sum(a * b for a, b in zip(v, w)), i) for i, w in rows if i != q and len(w) == len(v)))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    return sorted(out)


def test_top_k(spark, monkeypatch):
    rng = random.Random(7)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    rows = [(i, [c + rng.gauss(0, 0.1) for c in centres[min(4, rng.randrange(9))]]) for i in range(700)]
    rows += [(1000 + i, rows[7][1]) for i in range(30)]  # ties
    rows += [(2000, None), (2001, [1.0] * 5 + [None]), (2002, [float("nan")] * 6), (2003, [1.0, 2.0]), (2010, [3.0, 1.0]), (2020, []), (2030, [1e9] * 6), (None, [1.0] * 6), (1000, rows[7][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    monkeypatch.setattr(topk_join, "BLOCK_ROWS", 64)
    got = topk_join.top_k(df, df.where("vec_id % 10 = 0"), k=10, pivots=12).collect()
    assert sorted(map(tuple, got)) == searched(rows, lambda i: i % 10 == 0, 10)
    few = df.where("vec_id < 4")
    assert sorted(map(tuple, topk_join.top_k(few, few, k=10, pivots=3).collect())) == searched(rows[:4], lambda i: True, 10)
    assert topk_join.top_k(df.limit(0), df.limit(0)).count() == 0


# --- archives -------------------------------------------------------------------------------------

PAGES = [(1, "http://www.Example.com/a?x=1#f", "<p>é</p>"), (2, "https://u@sub.example.com:80/", "<p>é</p>"), (3, None, None), (4, "no url", ""), (5, "http://b.org/", "line\r\n\r\nWARC/1.1\r\n"),
         (6, "http://b.org/", "x" * 300000), (6, "http://b.org/", "x" * 300000), (None, "http://c.org/\n", "z"), (8, "http://c.org/", "z")]


def test_archives(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 2)
    pages = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, file string")
    got = sorted([tuple(r)[:5] for r in warc.archive_round_trip(pages).collect()], key=str)
    want = []
    for i, _, h in PAGES:
        payload = (h or "").encode()
        first = min((j for j, _, x in PAGES if (x or "") == (h or "") and j is not None), default=None)
        kind = "response" if i == first else "revisit"
        want.append((i, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), kind, first if kind == "revisit" else None))
    assert got == sorted(want, key=str)
    assert warc.archive_round_trip(pages.limit(0)).count() == 0
    least = {r.page_id: r.record_type for r in warc.archive_round_trip(pages, least=5).collect()}
    assert least[4] == "response" and least[2] == "revisit" and least[8] == "response"


def test_lookup(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    folder = f"file://{tmp_path}/warc"
    manifest = warc.write_archives(pages, folder)
    index = warc.build_index(manifest, folder)
    asked = spark.createDataFrame([("http://b.org/",), ("http://WWW.example.com/a?x=1",), ("http://none.org/",), (None,)], "url string")
    got = warc.lookup(index, asked)
    assert sorted((r.asked, r.id) for r in got.collect() if r.asked) == [("http://WWW.example.com/a?x=1", 1), ("http://b.org/", 5), ("http://b.org/", 6), ("http://b.org/", 6)]
    back = warc.read_records(got.where("id = 5"), folder, payload=True).first()
    assert bytes(back.payload) == PAGES[4][2].encode() and back.url == "http://b.org/"
    import gzip
    raw = b"".join(gzip.open(f).read() for f in tmp_path.glob("warc/*.warc.gz"))
    assert raw.count(b"WARC-Record-ID") == len(PAGES)


def test_only_needed_blocks_are_read(spark, tmp_path, monkeypatch):
    """Keys are found by bisection; blocks without one are skipped, and each other block is read once."""
    monkeypatch.setattr(warc, "BLOCK_LINES", 10)
    rows = [(i, f"http://host{i % 40:02d}.org/{i // 40:03d}", "x") for i in range(1000)] + [(2000 + i, "http://hot.org/", "y") for i in range(500)] + [(5000, None, "z")]
    folder = f"file://{tmp_path}/warc"
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    index = warc.build_index(warc.write_archives(pages, folder), folder)
    fs, path = warc.file_system_path(folder)
    files = [warc.IndexFile(fs, f"{path}/{name}") for _, _, name in index.top]
    whole = sum(len(f.directory) for f in files)
    keys = sorted(r.k for r in spark.createDataFrame([r for r in rows if r[0] % 25 == 0 and r[0] < 100], pages.schema).select(warc.url_key(F.col("url")).alias("k")).collect())
    got = [row[1] for f in files for k in keys for row in f.captures(k)]
    assert sorted(got) == [0, 25, 50, 75] and 0 < sum(f.blocks_read for f in files) <= 2 * len(keys) < whole / 4
    every = [warc.IndexFile(fs, f"{path}/{name}") for _, _, name in index.top]
    all_keys = sorted({r.k for r in pages.select(warc.url_key(F.col("url")).alias("k")).collect()})
    assert sorted(row[1] for f in every for k in all_keys for row in f.captures(k)) == sorted(r[0] for r in rows)
    assert sum(f.blocks_read for f in every) == whole
    asked = pages.where("page_id < 3 or page_id >= 2000").select(warc.url_key(F.col("url")).alias("key"))
    found = warc.captures_of(index, asked.union(asked).union(spark.createDataFrame([("none,such)/",), (None,)], "key string")))
    assert sorted(r.id for r in found.collect()) == [0, 1, 2, *range(2000, 2500), 5000]
    assert sorted(r.page_id for r in warc.archive_round_trip(pages).collect()) == sorted(r[0] for r in rows)
