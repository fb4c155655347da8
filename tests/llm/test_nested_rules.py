"""Cutoffs of the pipeline's quality stage where labels are few."""

import random

import pytest

import corpus_pipeline
from cohortlens.llm import quality_rules as qr

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(rng.randint(3, 7)))
    rows, labels = [], []
    for i in range(1000):
        lang, bad = "few" if i % 10 == 3 else None if i % 2 else "de", i % 8 in (0, 3)
        rows.append((i, " ".join(word() + ("#" if bad and j % 2 else "") for j in range(60)), lang, "s", 1))
        labels.append((i, 0 if bad else 1))
    folder = str(tmp_path_factory.mktemp("nested"))
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    return spark.createDataFrame(rows, SCHEMA), {i for i, q in labels if not q}, {r[0] for r in rows if r[2] == "few"}, folder


def test_some_hundred_labels_reject(spark, tables):
    docs, bad, few, folder = tables
    kept = {r.doc_id for r in corpus_pipeline.quality(spark, docs, folder).collect()}
    assert not kept & bad - few and kept >= few  # a stratum with too few labels loses none
    assert kept >= set(range(1000)) - bad


def test_guarantee_is_tested_on_the_others(spark, tables):
    docs, bad, _, folder = tables
    lab = spark.read.parquet(f"{folder}/labels.parquet")
    # labels without any relation to the text: a cutoff that rejects more than alpha of the good ones never passes
    mixed = lab.selectExpr("doc_id", "cast(hash(doc_id, 1) % 2 = 0 as int) quality")
    got = qr.judge(docs, mixed, cost=0.0, nested=True).collect()
    good = {r.doc_id for r in mixed.where("quality = 1").collect()}
    assert sum(not r.kept for r in got if r.doc_id in good) <= 0.02 * len(good)
    assert all(r.kept for r in qr.judge(docs, lab.limit(0), nested=True).collect())


def test_more_words_than_places(spark, monkeypatch):
    """Texts with more words than a packed window can number are counted word by word."""
    texts = ["a b c d a b c e", "x " * 40, "one two three four five six seven eight nine ten", "a b c " * 3 + "d e f g h i", None, "a b"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    want = sorted(map(tuple, qr.metrics(docs, "text", ["doc_id"]).collect()))
    monkeypatch.setattr(qr, "PLACE", 3)
    assert sorted(map(tuple, qr.metrics(docs, "text", ["doc_id"]).collect())) == want
