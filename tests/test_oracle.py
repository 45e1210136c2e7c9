"""Registered queries against their SQL on the smallest tables."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
from check import TABLES, compare  # noqa: E402

from __spark_entry__ import entry, oracle_sql, queries  # noqa: E402

SF = "/root/testdata/sf0.001"
# model fits of a minute and more; bench.py and tools/check.py run them
SLOW = {"boosted_trees", "boosted_trees_sampled", "best_k_search", "feature_importance", "importance_rank", "kmeans"}
# at this scale one event month holds a single record, its exact error is zero
TINY = {"event_study"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() == 931


@pytest.mark.parametrize("name", sorted(set(queries()) - SLOW - TINY))
def test_query(spark, duck, name):
    got = queries()[name](spark, SF).toPandas()
    assert len(got)
    if name in oracle_sql():
        assert compare(got, duck.execute(oracle_sql()[name]).df()).startswith("ok")
