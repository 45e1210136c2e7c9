"""The fits of the search for k move together and end where MLlib's fits end."""

import numpy as np
import pytest
from pyspark.ml.clustering import KMeans

from aforo.operators import clusters as K


def plain(rows, k, seed, tol=K.TOLERANCE):
    return KMeans(k=k, seed=seed, maxIter=K.MAX_ITER, tol=tol, featuresCol="zvec", predictionCol="cluster").fit(rows)


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(5)
    rows = [(i, *map(float, rng.normal(size=3))) for i in range(900)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double")
    return K.scaled_vectors(df, ["a", "b", "c"]).select("id", "zvec")


def test_a_pass_is_a_step_of_all_fits(spark, cloud):
    laid = cloud.coalesce(1).persist()
    steps = sum(plain(laid, k, 42 + i).summary.numIter for k in (2, 3, 4, 5) for i in range(3))
    laid.unpersist()
    sc = spark.sparkContext
    sc.setJobGroup("search", "search")
    try:
        K.best_k_search(cloud, ["id"], 2, 5, n_init=3)
        jobs = len(sc.statusTracker().getJobIdsForGroup("search"))
    finally:
        for name in ("spark.jobGroup.id", "spark.job.description"):
            sc.setLocalProperty(name, None)
    assert jobs < steps


@pytest.mark.parametrize("partitions", [1, 7])
def test_fits_end_where_plain_ones_end(cloud, partitions):
    rows = cloud.repartition(partitions, "id").sortWithinPartitions("id").persist()
    pairs = [(k, seed) for k in (2, 5, 3) for seed in (1, 2)]
    fits = K.fit_together(rows, K.starting_centres(rows, pairs))
    for (k, seed), (centres, cost) in zip(pairs, fits):
        model = plain(rows, k, seed)
        assert np.allclose(centres, model.clusterCenters(), atol=1e-9)
        assert cost == pytest.approx(model.summary.trainingCost, rel=1e-9)
    rows.unpersist()


def test_scores_are_those_of_the_best_plain_fit(cloud):
    rows = cloud.repartition(1, "id").sortWithinPartitions("id").persist()
    got = {r["k"]: r["silhouette"] for r in K.best_k_search(cloud, ["id"], 2, 4, n_init=3).collect()}
    for k, score in got.items():
        best = min((plain(rows, k, K.SEED + i) for i in range(3)), key=lambda m: m.summary.trainingCost)
        assert score == pytest.approx(K.silhouette(best.transform(rows)), rel=1e-9)
    rows.unpersist()


def test_points_far_from_zero_keep_their_digits(spark):
    rows = K.VectorAssembler(inputCols=["x"], outputCol="zvec").transform(
        spark.range(40).selectExpr("id", "1e9 + id % 2 + id / 1000 as x")
    ).persist()
    (centres, _), = K.fit_together(rows, [[np.array([1e9]), np.array([1e9 + 0.9])]])
    assert sorted(c[0] - 1e9 for c in centres) == pytest.approx([0.019, 1.02], abs=1e-6)
    rows.unpersist()


def test_ties_and_equal_centres_go_to_the_first(spark):
    rows = K.VectorAssembler(inputCols=["x"], outputCol="zvec").transform(
        spark.createDataFrame([(0.0,), (1.0,), (2.0,)], "x double")
    ).persist()
    starts = [[np.array([c]) for c in (0.0, 2.0)], [np.array([c]) for c in (1.0, 1.0, 9.0)]]
    two, three = K.fit_together(rows, starts, max_iter=1)
    assert two[0].ravel().tolist() == pytest.approx([0.5, 2.0])
    assert three[0].ravel().tolist() == pytest.approx([1.0, 1.0, 9.0])
    assert two[1] == pytest.approx(1.0) and three[1] == pytest.approx(2.0)
    rows.unpersist()


def test_few_distinct_points_have_few_centres(spark):
    rows = K.scaled_vectors(spark.range(30).selectExpr("id", "cast(id % 3 as double) x"), ["x"])
    got = K.best_k_search(rows, ["id"], 2, 5, n_init=2).orderBy("k").collect()
    assert [r["k"] for r in got] == [2, 3, 4, 5]
    assert [r["silhouette"] for r in got[1:]] == pytest.approx([1.0] * 3)


def test_equal_points_score_nothing(spark):
    rows = K.VectorAssembler(inputCols=["x"], outputCol="zvec").transform(spark.range(5).selectExpr("id", "1.0 as x"))
    assert [r["silhouette"] for r in K.best_k_search(rows, ["id"], 2, 3, n_init=1).collect()] == [0.0, 0.0]
