"""Registered queries: every survey operator has one; a sample is compared with its oracle."""

import importlib.util
import os
import re

import duckdb
import pytest

import __spark_entry__ as entry
from cohortlens.plans import load
from cohortlens.session import own_folder
from tools.check_oracle import TABLES, compare

FOLDER = "/root/testdata/sf0.001"
EXPECTED = ([f"A{i}" for i in range(1, 14)] + [f"B{i}" for i in range(1, 22)] + [f"C{i}" for i in range(1, 17)]
            + [f"D{i}" for i in range(1, 27)] + [f"E{i}" for i in range(1, 16)] + [f"F{i}" for i in range(1, 4)]
            + [f"G{i}" for i in range(1, 7)] + ["H1", "H2"] + [f"I{i}" for i in range(1, 26)] + [f"J{i}" for i in range(25)]
            + [f"K{i}" for i in range(1, 14)] + [f"L{i}" for i in range(1, 29)] + [f"M{i}" for i in range(1, 10)]
            + ["N1", "N2", "N3", "O1"])


def test_every_operator_is_registered():
    seen = {i for q in load().values() for i in q.ids.split(",")}
    assert [i for i in EXPECTED if i not in seen] == []


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    # the training-data queries are there exactly if their subpackage is
    dealt = {m[0] for n in entry.queries() if (m := re.match(r"op\d+_|pipeline", n))}
    assert dealt == ({"pipeline", *(f"op{i}_" for i in range(1, 14))} if importlib.util.find_spec("cohortlens.llm") else set())


def test_a_cluster_without_a_shared_folder_is_refused():
    for master in ("yarn", "spark://host:7077", "k8s://host", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            own_folder(master)
    assert os.path.isdir(own_folder("local[4]"))


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 21


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{FOLDER}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", ["auc_decompose", "auc_by_group", "pr_grid", "threshold_for_ppv", "group_quantiles", "rolling_outliers",
                                  "compare_bootstrap", "fdr", "sequential_monitor", "nearest_match", "expanding_folds", "tokens",
                                  "union_periods", "univariate_scores", "key_overlap"])
def test_oracle(spark, con, name):
    got = entry.queries()[name](spark, FOLDER).toPandas()
    assert compare(got, con.execute(entry.oracle_sql()[name]).df()) == "ok"
