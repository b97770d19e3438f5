from __future__ import annotations

import pytest

LONG = "word " * 30_000

#: doc_id, text: nulls, empty, very long, repeated rows, ties of ids.
ODD = [
    (1, None), (2, ""), (3, "   \n\t"), (4, LONG), (5, "plain text of a few words here and there"), (5, "plain text of a few words here and there"),
    (6, "plain text of a few words here and there"), (None, "text without an id"), (None, None), (7, "x" * 50_000), (7, "another text with the same id"),
    (8, "ünïcödé \U0001f600 and 中文 words"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """The odd rows, with nulls in other columns and columns named like results."""
    rows = [(i, t, None, None, None, "a", "b", 1.5, "c") for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string, items string, score double, spans string")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
