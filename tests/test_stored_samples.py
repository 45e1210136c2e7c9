"""Samples read keys or hashes that are dear to compute from a stored table."""

import pytest

from catalog.queries import QUERIES


@pytest.mark.parametrize("name", ["sample_rows", "sample_rows_text_keys"])
def test_samples_read_a_stored_table(spark, name):
    files = QUERIES[name](spark, "/root/testdata/sf0.001").inputFiles()
    assert files and all("/aforo/" in f for f in files)
