import sys

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, op string"


@pytest.fixture
def docs(spark):
    """Documents from texts: nulls, empty ones, ties and a column whose name clashes with nothing we promise."""

    def make(texts, sources=None):
        rows = [(i, t, "en", sources[i] if sources else f"src{i % 3}", None if t is None else len(t), "x") for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, DOCS)

    return make


sys.setrecursionlimit(10_000)
