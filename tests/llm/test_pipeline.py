"""The pipeline against a brute-force one, stage by stage."""

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from test_corpus import linked, measured

FOLDER = "/root/testdata/sf0.001"


def packed(rows, path):
    library = Tokenizer.from_file(path)
    out = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        out += [(i, p, s, len(ids[s:s + 2048]), zlib.crc32(np.array(ids[s:s + 2048], "<u4").tobytes())) for p, s in enumerate(range(0, len(ids), 2048))]
    return sorted(out, key=str)


def passes(text):
    n_words, _, _, _, n_repeat = measured(text)
    return n_words >= 50 and 100 * n_repeat <= 50 * n_words


def test_run(spark, tokenizer_path):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    # too few labels for a cutoff: the base rules decide
    good = [(i, t) for i, t in rows if any(c.isalpha() for c in t or "") and passes(t)]
    first = {i: c for i, _, c in linked(good, 5, 80)}
    kept = [(i, t) for i, t in good if first[i] == i]
    got = corpus_pipeline.run(spark, FOLDER).collect()
    assert sorted([tuple(r)[:5] for r in got], key=str) == packed(kept, tokenizer_path("word_bpe_49k.json"))
    assert len({r.sequence_id for r in got}) <= 1.02 * sum(r.length for r in got) / 2048 + 1


def test_stages_return_the_columns(spark, odd_docs, no_docs):
    long = " ".join(f"word{i}" for i in range(60))
    more = spark.createDataFrame([(20, long, "en", "s", 1, "k", 0.5), (21, long, "en", "s", 1, "k", 0.5), (21, long, "en", "s", 1, "k", 0.5), (None, long, None, None, None, None, None), (19, long + " 1 2 3", "en", "s", 1, "k", 0.5)], odd_docs.schema)
    docs = odd_docs.union(more)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER)
        assert docs.columns == odd_docs.columns
        docs = spark.createDataFrame(docs.collect(), odd_docs.schema)
        if name == "language":
            assert {1, 2, 3}.isdisjoint(r.doc_id for r in docs.collect())
        if name == "quality":  # short and repetitive texts go
            assert sorted((r.doc_id or 0) for r in docs.collect()) == [0, 19, 20, 21, 21]
    assert sorted((r.doc_id or 0) for r in docs.collect()) == [0, 19]
    empty = no_docs
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, FOLDER)
    assert empty.count() == 0


def test_ids_repeated_in_a_kept_group(spark):
    one, two = (" ".join(f"{c}{i}" for i in range(30)) for c in "ab")
    docs = spark.createDataFrame([(1, one, None, None, None), (1, one, None, None, None), (2, two, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, FOLDER).collect()) == [1, 2]


@pytest.mark.parametrize("name", ["op1_warc", "op5_top_k", "op7_quality_rules", "op9_near_dedup"])
def test_oracle(spark, name):
    import duckdb

    from cohortlens.llm import queries

    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "labels"):
        con.execute(f"create view {t} as select * from read_parquet('{FOLDER}/{t}.parquet')")
    want = con.execute(queries.ORACLES[name])
    names = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, FOLDER).select(*names).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want.fetchall()))


def test_every_dealt_operator_is_registered():
    from cohortlens.llm import queries

    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
