"""Cases that once went wrong silently."""

import pytest
from pyspark.sql import functions as F

from aforo.operators import aggregates, isolation, panel, quantiles, regression
from aforo.sources import billing, results


@pytest.mark.parametrize(
    ("kind", "method", "aggregates_"),
    [("int", "nearest", ()), ("decimal(12,3)", "linear", ("n",)), ("double", "nearest", ("n",)), ("double", "linear", ())],
)
def test_quantiles_do_not_depend_on_the_size_of_groups(spark, kind, method, aggregates_):
    rows = [(g, (i * 7) % 11 if g != "empty" else None) for g in ("a", "b", "empty", None) for i in range(1 + 3 * len(g or ""))]
    df = spark.createDataFrame(rows, "g string, v long").withColumn("v", F.col("v").cast(kind))
    if kind == "double":
        df = df.union(spark.createDataFrame([("a", float("nan")), ("nan", float("nan"))], "g string, v double"))
    more = [F.count(F.lit(1)).alias(a) for a in aggregates_]
    probs = {"q0": 0.0, "m": 0.5, "q9": 0.9}
    plain, hot = (quantiles.group_quantiles(df, ["g"], "v", probs, more, method, hot_rows=h) for h in (None, 1))
    assert plain.schema.simpleString() == hot.schema.simpleString()
    assert sorted(map(str, plain.collect())) == sorted(map(str, hot.collect()))


def test_forest_scoring_keeps_keys(spark):
    rows = [(9007199254740993, 1.0), (None, 2.0), (3, 50.0)]
    df = spark.createDataFrame(rows, "k long, x double").coalesce(1)
    nodes = isolation.isolation_forest_fit(df, ["x"], ["k"], n_trees=3, sample_size=4)
    scored = isolation.isolation_forest_score(df, ["x"], nodes).collect()
    assert {(r.k, r.x) for r in scored} == set(rows) and all(0 < r.score <= 1 for r in scored)


def test_short_control_groups_are_refused(spark):
    treated = spark.createDataFrame([(i, i, 5) for i in range(10)], "codcon long, codudu long, mes_evento int")
    candidates = spark.createDataFrame([(100 + i, i) for i in range(5)], "codcon long, codudu long")
    with pytest.raises(ValueError, match="20 controls wanted, 5"):
        panel.sample_controls(treated, candidates, 2)
    assert panel.sample_controls(treated, candidates, 2, allow_short=True).count() == 5


def test_rows_without_outcome_are_no_observations(spark):
    rows = [(1, 1.0, 2.0), (2, 2.0, 4.0), (3, 3.0, 6.5), (4, 4.0, None), (5, None, 1.0)]
    df = spark.createDataFrame(rows, "codcon long, x double, y double").withColumn("codudu", F.col("codcon"))
    terms = [regression.intercept(), regression.numeric("x", "x")]
    got = {r.term: r for r in regression.ols(df, "y", terms).collect()}
    assert got["x"].n_obs == 3 and got["x"].n_clusters == 3 and got["x"].coef == pytest.approx(2.25)


def test_an_id_column_is_no_category(spark):
    ids = spark.range(20_000).withColumn("y", F.rand(1))
    with pytest.raises(ValueError, match="too many levels"):
        regression.design_statistics(ids, ["id"], [])
    with pytest.raises(ValueError, match="more than 100 levels"):
        aggregates.distinct_values(ids, ["id"], most=100)


def test_samples_by_text_and_repeated_keys(spark):
    words = spark.createDataFrame([(f"key {i}", i) for i in range(300)], "k string, v int")
    one = billing.sample_rows(words, 40, ["k"]).collect()
    assert len(one) == 40 and sorted(one) == sorted(billing.sample_rows(words.repartition(5), 40, ["k"]).collect())
    repeated = spark.createDataFrame([(1, i) for i in range(20)], "k long, v int")
    assert billing.sample_rows(repeated, 5, ["k"]).count() == 5


def test_the_newest_document_is_read(spark, tmp_path):
    import os

    for i, name in enumerate(["TOTAL a", "TOTAL b"]):
        file = tmp_path / f"{i}.json"
        file.write_text('{"analisis": [{"nombre": "X"}, {"nombre": "%s"}]}' % name)
        os.utime(file, (1_700_000_000 - i, 1_700_000_000 - i))
    assert results.result_json_read(spark, str(tmp_path)).first()["nombre"] == "TOTAL a"
    assert results.latest_result(spark, str(tmp_path)).first()["file_path"].endswith("0.json")
