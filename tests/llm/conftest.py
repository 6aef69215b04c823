from __future__ import annotations

import os

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def llm(spark):
    """The session, with the library on the workers' path."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    spark.sparkContext.environment["PYTHONPATH"] = root
    return spark


@pytest.fixture(scope="session")
def sf():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    return SF


#: Rows every operator must bear: nulls, empty and long texts, ties, repeated rows.
ODD = [
    (None, "Text without a key, plain and short.", "a"),
    (1, None, "b"),
    (2, "", None),
    (3, "word " * 40_000, "a"),
    (4, "The same text stands twice here, word for word, in two rows of the table.", "a"),
    (4, "The same text stands twice here, word for word, in two rows of the table.", "a"),
    (5, "\t\n \x0b", "c"),
    (6, "Größe 漢字   naïve \U0001f600 end", "c"),
]


@pytest.fixture(scope="session")
def odd(llm):
    """Columns beyond the documents' own have names the operators use themselves."""
    rows = [(*r, i, str(i), 0.5) for i, r in enumerate(ODD)]
    return llm.createDataFrame(rows, "doc_id long, text string, source string, `row` long, c0 string, n double")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
