import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))


@pytest.fixture(scope="session")
def documents(spark):
    """Builds a table of documents from (id, text[, source[, lang]]) rows, with a column of a clashing name."""

    def make(rows, source="s", lang="en"):
        full = [(*r, *(source, lang)[len(r) - 2 :], "x", 1) for r in rows]
        return spark.createDataFrame(full, "doc_id long, text string, source string, lang string, key string, size int")

    return make
