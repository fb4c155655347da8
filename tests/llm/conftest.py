"""The package reaches the Python workers of the shared session."""

import public_tokenizers
import pytest

from cohortlens.session import ship_package


@pytest.fixture(autouse=True)
def shipped(spark):
    ship_package(spark)


@pytest.fixture(scope="session")
def tokenizer_path():
    return public_tokenizers.path


#: Texts that every operator on texts must stand: null, empty, blank, repeated, long, beyond ASCII.
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "word"), (4, "word"), (None, "no id here"), (5, "Zoë's 日本 naïve 😀 test, it's\n\nfine "),
       (6, "la la la " * 3000), (7, "x" * 20000), (8, "the same text of seven plain words"), (9, "the same text of seven plain words")]


@pytest.fixture
def odd_docs(spark):
    """Documents with odd texts and with extra columns whose names clash with results and helpers."""
    rows = [(i, t, "en" if i and i % 2 else None, "src", 0, "k", 1.5) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id string, score double")


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
