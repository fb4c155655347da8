"""Queries that go over all folds, years, classes and components of the given tables."""

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from tools.check_oracle import compare

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def years(spark):
    return [r[0] for r in spark.read.parquet(f"{FOLDER}/orders.parquet").selectExpr("year(o_orderdate) y").distinct().orderBy("y").collect()]


@pytest.mark.parametrize("name", ["fit_folds", "fit_by_risk_bin", "fit_by_annotation"])
def test_all_folds(spark, years, name):
    got = entry.queries()[name](spark, FOLDER).collect()
    assert sorted({r["fold"] for r in got}) == years[1:]


def test_gate_judges_all_years(spark, years, monkeypatch):
    from cohortlens.operators import impute

    seen = []
    gate = impute.gate_by_year
    monkeypatch.setattr(impute, "gate_by_year", lambda df, cols, period, *rest: seen.extend(r[0] for r in df.select(period).distinct().collect()) or gate(df, cols, period, *rest))
    assert entry.queries()["impute_gate"](spark, FOLDER).count() == 2
    assert sorted(seen) == years


@pytest.mark.parametrize("name,pairs", [("auc_pairwise_all", 45), ("spearman_ci_all", 21)])
def test_all_pairs(spark, name, pairs):
    con = duckdb.connect()
    for t in ("embeddings", "lineitem"):
        con.execute(f"create view {t} as select * from read_parquet('{FOLDER}/{t}.parquet')")
    got = entry.queries()[name](spark, FOLDER).toPandas()
    assert len(got.drop_duplicates(["y0", "y1"] if "y0" in got else ["pair"])) == pairs
    assert compare(got, con.execute(entry.oracle_sql()[name]).df()) == "ok"


@pytest.mark.parametrize("kind", ["lda", "qda"])
def test_discriminant_reads_all_components(spark, kind):
    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet").select("label", "embedding").collect()
    x, y = np.array([r.embedding for r in rows], float), np.array([r.label for r in rows])
    centred = {k: x[y == k] - x[y == k].mean(axis=0) for k in set(y)}
    pooled = sum(c.T @ c for c in centred.values()) / (len(y) - len(centred))
    logp = {}
    for k, c in centred.items():
        sigma = (pooled if kind == "lda" else c.T @ c / (len(c) - 1)) + 1e-6 * np.eye(64)
        d = x - x[y == k].mean(axis=0)
        logp[k] = np.log(len(c) / len(y)) - 0.5 * np.linalg.slogdet(sigma)[1] - 0.5 * (d * np.linalg.solve(sigma, d.T).T).sum(axis=1)
    pred = np.array(list(logp))[np.stack(list(logp.values())).argmax(axis=0)]
    got = {r.label: (r.n, r.hits) for r in entry.queries()[f"discriminant_{kind}"](spark, FOLDER).collect()}
    assert got == {k: ((y == k).sum(), (pred[y == k] == k).sum()) for k in set(y)}
