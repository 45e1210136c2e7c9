"""Scaling, clusters, trees, isolation forest."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from aforo.operators import clusters as K
from aforo.operators import encode as E
from aforo.operators import impact as I
from aforo.operators import isolation as IF
from aforo.operators import trees as B
from aforo.sources.billing import sample_rows


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(5)
    centres = [(0, 0), (10, 0), (0, 12)]
    rows = [
        (i, float(centres[i % 3][0] + rng.normal()), float(centres[i % 3][1] + rng.normal()), i % 3)
        for i in range(240)
    ]
    return spark.createDataFrame(rows, "id long, x double, y double, truth int")


def test_constant_feature_has_scale_one(spark):
    df = spark.createDataFrame([(1.0, 4.0), (3.0, 4.0)], "a double, b double")
    rows = E.standardise(df, ["a", "b"]).collect()
    assert [r["z_a"] for r in rows] == [-1.0, 1.0]
    assert [r["z_b"] for r in rows] == [0.0, 0.0]


def test_split_is_stable_and_near_its_share(spark):
    df = spark.range(20_000).withColumnRenamed("id", "k")
    train, test = E.train_test_split(df, ["k"])
    n = test.count()
    assert train.count() + n == 20_000
    assert abs(n / 20_000 - 0.2) < 0.02
    again = E.train_test_split(df.repartition(11), ["k"])[1]
    assert again.exceptAll(test).count() == 0


def test_label_codes_are_alphabetical(spark):
    df = spark.createDataFrame([("b",), ("c",), ("a",), ("b",)], "c string")
    assert [r["c_idx"] for r in E.label_encode(df, ["c"]).collect()] == [1.0, 2.0, 0.0, 1.0]


def brute_silhouette(x, labels, squared):
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    d = d if squared else np.sqrt(d)
    out = []
    for i in range(len(x)):
        own = labels == labels[i]
        if own.sum() == 1:
            out.append(0.0)
            continue
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, labels == c].mean() for c in set(labels) if c != labels[i])
        out.append((b - a) / max(a, b))
    return float(np.mean(out))


def test_silhouettes_match_brute_force(blobs):
    labelled = K.scaled_vectors(blobs, ["x", "y"]).withColumn(
        "cluster", F.when(F.col("id") == 0, 4).otherwise(F.col("truth"))
    )
    pdf = labelled.toPandas()
    x = np.vstack([v.toArray() for v in pdf["zvec"]])
    labels = pdf["cluster"].to_numpy()
    got = K.silhouette_sample(labelled, ["id"], ["cluster"], 1_000).first()
    assert got["silhouette_sample"] == pytest.approx(brute_silhouette(x, labels, False), rel=1e-9)
    assert got["n_sample"] == 240
    assert K.silhouette(labelled) == pytest.approx(brute_silhouette(x, labels, True), rel=1e-9)


def test_search_finds_three_blobs(blobs):
    scores = K.best_k_search(K.scaled_vectors(blobs, ["x", "y"]), ["id"], k_max=4, n_init=2).collect()
    assert [r["k"] for r in sorted(scores, key=lambda r: r["k"])] == [2, 3, 4]
    assert max(scores, key=lambda r: r["silhouette"])["k"] == 3
    model = K.kmeans(K.scaled_vectors(blobs, ["x", "y"]), 3, n_init=2)
    pure = model.transform(K.scaled_vectors(blobs, ["x", "y"])).groupBy("cluster").agg(
        F.count_distinct("truth").alias("d")
    )
    assert [r["d"] for r in pure.collect()] == [1, 1, 1]


def test_k_stays_below_the_sample(blobs):
    tiny = blobs.filter("id < 4")
    scores = K.best_k_search(K.scaled_vectors(tiny, ["x", "y"]), ["id"], n_init=1).collect()
    assert sorted(r["k"] for r in scores) == [2, 3]


def test_assignment_and_profiles(blobs):
    labelled = K.assign_clusters(blobs, ["x", "y"], [[0.0, 0.0], [10.0, 0.0], [0.0, 12.0]])
    assert labelled.filter("cluster <> truth").count() == 0
    profiles = K.cluster_profiles(labelled, ["x", "y"]).collect()
    assert sum(r["n"] for r in profiles) == 240
    assert sum(r["pct"] for r in profiles) == pytest.approx(100.0)


def test_sample_is_exact_and_stable(spark):
    df = spark.range(3_000).withColumnRenamed("id", "k")
    a = {r["k"] for r in sample_rows(df, 100, ["k"]).collect()}
    b = {r["k"] for r in sample_rows(df.repartition(7), 100, ["k"]).collect()}
    assert a == b and len(a) == 100
    assert sample_rows(df, 5_000, ["k"]).count() == 3_000


@pytest.fixture(scope="module")
def odd(spark):
    rng = np.random.default_rng(11)
    rows = [(i, float(rng.normal()), float(rng.normal())) for i in range(600)]
    rows += [(1000 + i, 9.0 + i, -9.0 - i) for i in range(6)]
    return spark.createDataFrame(rows, "id long, x double, y double")


def walk(nodes, point):
    """Path length of one point in one tree, node by node."""
    at = 0
    while nodes[at]["feature"] >= 0:
        at = nodes[at]["left"] if point[nodes[at]["feature"]] <= nodes[at]["threshold"] else nodes[at]["right"]
    return nodes[at]["depth"] + IF.mean_path(nodes[at]["size"])


def test_isolation_forest_scores_and_outliers(odd):
    nodes = IF.isolation_forest_fit(odd, ["x", "y"], ["id"], n_trees=40, sample_size=64).persist()
    trees = {}
    for r in nodes.collect():
        trees.setdefault(r["tree_id"], {})[r["node_id"]] = r.asDict()
    assert len(trees) == 40
    assert all(t[0]["size"] == 64 for t in trees.values())
    assert max(n["depth"] for t in trees.values() for n in t.values()) <= 6
    scored = IF.isolation_forest_score(odd, ["x", "y"], nodes, 40, 64).collect()
    for r in scored[::60]:
        mean = np.mean([walk(t, (r["x"], r["y"])) for t in trees.values()])
        assert r["score"] == pytest.approx(2 ** (-mean / IF.mean_path(64)), rel=1e-9)
    top = sorted(scored, key=lambda r: -r["score"])[:6]
    assert all(r["id"] >= 1000 for r in top)


def test_anomaly_pipeline(odd):
    flagged = IF.detect_anomalies(odd, ["x", "y"], ["id"], 0.01, n_trees=40, sample_size=64)
    rows = flagged.collect()
    n = sum(r["es_anomalia"] for r in rows)
    assert 5 <= n <= 7
    cut = np.quantile([r["score"] for r in rows], 0.99)
    assert {r["id"] for r in rows if r["es_anomalia"]} == {r["id"] for r in rows if r["score"] > cut}
    again = IF.detect_anomalies(odd.repartition(7), ["x", "y"], ["id"], 0.01, n_trees=40, sample_size=64)
    assert {(r["id"], r["score"]) for r in again.collect()} == {(r["id"], r["score"]) for r in rows}
    top = IF.top_anomalies(flagged, ["id"], 3).collect()
    assert [r["anomaly_score"] for r in top] == sorted((r["anomaly_score"] for r in rows), reverse=True)[:3]
    comparison = {r["feature"]: r for r in IF.anomaly_comparison(flagged, ["x", "y"]).collect()}
    assert comparison["x"]["n_anomalias"] == n and comparison["x"]["n_total"] == 606


def test_comparison_with_zero_normal_mean(spark):
    df = spark.createDataFrame([(0.0, False), (5.0, True)], "v double, es_anomalia boolean")
    assert IF.anomaly_comparison(df, ["v"]).first()["ratio"] == 0.0


def test_boosted_trees_learn(spark):
    rows = [(i, 2021, 1 + i % 12, "D%d" % (i % 4), "Verano", i % 36, i % 7, 0.5, 1.0, 2.0, 3.0,
             float((i % 4) * 10 + (i % 36))) for i in range(400)]
    df = spark.createDataFrame(
        rows,
        "coddis long, nuanio int, nummes int, nomdis string, estacion string, mes_absoluto int, num_unidades int, "
        "score_calidad double, pct_domestico double, pct_comercial double, pct_subsidiado double, "
        "consumo_promedio double",
    )
    for run in (B.boosted_trees, B.boosted_trees_sampled):
        fit = run(df, "C", maxIter=10, stepSize=0.3)
        metrics = B.regression_metrics(fit.predictions).first()
        assert fit.n_train + fit.n_test == 400
        assert metrics["r2"] > 0.8 and metrics["rmse"] >= metrics["mae"]
        gains = B.importance_rank(B.feature_importance(fit, spark)).collect()
        assert sum(r["importance"] for r in gains) == pytest.approx(1.0)
        assert {gains[0]["feature"], gains[1]["feature"]} == {"nomdis", "mes_absoluto"}
        assert B.split_counts(fit, spark).agg(F.sum("splits")).first()[0] > 0


def test_alerts_and_impact(spark):
    df = spark.createDataFrame([(1, 11.5, 10.0), (2, 10.5, 10.0), (3, 8.0, 10.0), (4, 1.0, 0.0)],
                               "id int, a double, p double")
    assert sorted(r["id"] for r in I.deviation_alerts(df, "a", "p").collect()) == [1, 3]
    effects = spark.createDataFrame([(632214, 0.4)], "n_units long, coef double")
    row = I.policy_impact(effects, 5.0).first()
    assert row["facturacion_anual"] == pytest.approx(632214 * 0.4 * 60)
    comparison = spark.createDataFrame(
        [("consumo_promedio", 14.46, 212.66, 4405)], "feature string, normal double, anomalia double, n_anomalias long"
    )
    assert I.excess_loss(comparison, 5.0).first()["exceso_mensual_m3"] == pytest.approx(4405 * 198.2)


def clouds(spark, centres, per=200):
    rng = np.random.default_rng(8)
    rows = [(i * per + j, *(float(v) for v in rng.normal(c, 0.05))) for i, c in enumerate(centres) for j in range(per)]
    return spark.createDataFrame(rows, "id long, x double, y double")


def test_start_centres_find_every_blob(spark):
    centres = [(0, 0), (5, 0), (0, 5), (9, 9), (-7, 3)]
    df = clouds(spark, centres)
    got = K.start_centres(df, ["x", "y"], 5, ["id"])
    d = ((np.array(got)[:, None] - np.array(centres)[None]) ** 2).sum(axis=2)
    assert sorted(d.argmin(axis=1)) == [0, 1, 2, 3, 4] and d.min(axis=1).max() < 0.1


def test_start_centres_do_not_depend_on_the_layout(spark):
    df = clouds(spark, [(0, 0), (3, 3), (9, 0)], per=90)
    one = K.start_centres(df.coalesce(1), ["x", "y"], 3, ["id"])
    many = K.start_centres(df.repartition(7), ["x", "y"], 3, ["id"])
    np.testing.assert_allclose(one, many, rtol=1e-12)


def test_start_centres_are_distinct_points(spark):
    """Repeated rows are drawn together and count by weight only; there are no more centres than points."""
    df = spark.createDataFrame([(1, 0.0), (1, 0.0), (2, 4.0)] * 50, "id long, x double")
    assert sorted(K.start_centres(df, ["x"], 5, ["id"])) == [[0.0], [4.0]]
    assert K.start_centres(df.limit(0), ["x"], 5, ["id"]) == []


def test_forest_shape_finds_a_broken_tree(spark):
    nodes = [(0, 0, 1, 0.5, 1, 2, 0, 10), (0, 1, -1, 0.0, -1, -1, 1, 4), (0, 2, -1, 0.0, -1, -1, 1, 6), (1, 0, -1, 0.0, -1, -1, 0, 10)]
    good = IF.forest_shape(spark.createDataFrame(nodes, IF.NODE_SCHEMA)).first()
    assert tuple(good) == (2, 10, 10, 1, 20, 0)
    broken = [(*n[:-1], 5) if n[:2] == (0, 1) else n for n in nodes]
    assert IF.forest_shape(spark.createDataFrame(broken, IF.NODE_SCHEMA)).first()["wrong_parents"] == 1
    assert IF.forest_shape(spark.createDataFrame(nodes[:2], IF.NODE_SCHEMA)).first()["wrong_parents"] == 1


def test_out_of_fold_predicts_every_row_without_itself(spark):
    """A row with a level of its own gets the prediction of the others."""
    rows = [(i, 2021, 1 + i % 12, f"D{i % 5}", 2021.0 + i % 7, 10.0 * (i % 5)) for i in range(400)]
    df = spark.createDataFrame(rows, "coddis int, nuanio int, nummes int, nomdis string, mes_absoluto double, consumo_promedio double")
    odd = df.limit(1).withColumn("consumo_promedio", F.lit(1e6))
    both = df.exceptAll(df.limit(1)).union(odd)
    out = B.out_of_fold(both, "C", 4, maxIter=2, maxDepth=3)
    assert out.count() == 400 and out.select("coddis").distinct().count() == 400
    assert {r["fold"] for r in out.select("fold").distinct().collect()} == {0, 1, 2, 3}
    assert out.filter("consumo_promedio = 1e6").first()["prediction"] < 1000
