"""Near duplicates where one id has several texts."""

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_texts_of_one_id_are_judged_each(spark):
    one, two, three = (" ".join(f"{c}{i}" for i in range(30)) for c in "abc")
    texts = [(1, one), (2, one), (2, two), (2, two), (2, three), (3, three), (4, None), (4, ""), (None, one)]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in texts], SCHEMA)
    got = corpus_pipeline.near_dedup(spark, docs, "").collect()
    assert sorted(((r.doc_id or 0, r.text or "") for r in got)) == [(0, one), (1, one), (2, two), (2, three), (4, "")]
    assert corpus_pipeline.near_dedup(spark, docs, "").columns == docs.columns
