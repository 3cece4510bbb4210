import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))


@pytest.fixture
def docs(spark):
    """Documents with every odd case: null id, null and empty text, repeated rows, a clashing extra column."""

    def make(rows):
        return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, score string")

    return make


ODD = [
    (1, "alpha beta gamma", "x", "y"),
    (1, "alpha beta gamma", "x", "y"),
    (2, None, None, None),
    (3, "", "x", "y"),
    (None, "alpha", None, "y"),
    (4, " \t\n ", "x", None),
    (5, "word " * 30000, "x", "y"),
    (6, "Ünïcödé 😀 ﷽ <|endoftext|> token", "x", "y"),
]


@pytest.fixture
def odd(docs):
    return docs(ODD)


@pytest.fixture
def empty(docs):
    return docs([])
