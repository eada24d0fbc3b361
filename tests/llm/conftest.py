import pytest

#: Nulls, empty and very long texts, repeated rows, and other columns whose names the operators use themselves.
ODD = [(1, None), (2, ""), (3, "a"), (4, "word " * 30_000), (5, "Same text twice, here."), (5, "Same text twice, here."), (None, "no id"), (6, "    \n\t "), (7, "x" * 3_000), (8, "Ünïcode 北京 don't 12٣ \U0001f600 it's")]


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(i, t, "en", None, 0, "clash", 1.5) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, _fp double")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")
