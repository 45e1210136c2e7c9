"""Rows that a query reads several times are computed once and stored."""

import pytest

from aforo.operators import clusters as K
from aforo.operators import encode as E
from aforo.operators import regression as G
from catalog import queries as C

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["standardise", "assign_clusters", "label_encode"])
def test_features_are_read_from_a_stored_table(spark, name):
    files = C.QUERIES[name](spark, SF).inputFiles()
    assert files and all("/aforo/" in f for f in files)


@pytest.mark.parametrize("name", ["silhouette", "cluster_profiles", "silhouette_by_k", "best_k_search_1d", "kmeans_1d"])
def test_scaling_reads_a_stored_table(spark, name, monkeypatch):
    seen = []
    for module in (E, K):
        real = module.scaling
        monkeypatch.setattr(module, "scaling", lambda df, f, real=real: seen.extend(df.inputFiles()) or real(df, f))
    C.QUERIES[name](spark, SF).collect()
    assert seen and all("/aforo/" in f for f in seen)


def test_codes_of_districts_read_a_stored_table(spark, monkeypatch):
    seen, real = [], E.label_encode
    monkeypatch.setattr(E, "label_encode", lambda df, c: seen.extend(df.inputFiles()) or real(df, c))
    C.QUERIES["categorical_features"](spark, SF).collect()
    assert seen and all("/aforo/" in f for f in seen)


@pytest.mark.parametrize("name", ["ols_fit_stats", "cluster_robust_se", "coef_interval", "ols_covariate_fwl", "cluster_scores"])
def test_regressions_read_a_stored_table(spark, name, monkeypatch):
    seen, real = [], G.ols_normal_equations
    monkeypatch.setattr(G, "ols_normal_equations", lambda df, *a: seen.extend(df.inputFiles()) or real(df, *a))
    C.QUERIES[name](spark, SF).collect()
    assert seen and all("/aforo/" in f for f in seen)


def test_search_fits_on_few_partitions(spark, monkeypatch):
    seen = []

    class Means(K.KMeans):
        def fit(self, rows):
            seen.append(rows.rdd.getNumPartitions())
            return super().fit(rows)

    monkeypatch.setattr(K, "KMeans", Means)
    rows = K.scaled_vectors(spark.range(0, 40, 1, 16).selectExpr("id", "cast(id % 4 as double) a"), ["a"])
    K.best_k_search(rows, ["id"], 2, 2, n_init=1)
    assert seen == [1]
