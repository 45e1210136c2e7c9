"""Sources, sinks, result documents and whole jobs on the smallest tables."""

import pytest

from aforo.plans import jobs
from aforo.session import scratch_path
from aforo.sources import billing, results, sinks
from catalog.fixture import consumo

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def fact(spark):
    path = scratch_path(spark, "consumo")
    consumo(spark, SF).write.parquet(path)
    return path


@pytest.fixture(scope="module")
def tables(spark, fact):
    out = {}
    for t in "ABC":
        out[t] = scratch_path(spark, f"table-{t}")
        report = jobs.build_features(spark, fact, t, out[t]).first()
        assert report["rows_in"] == 6000
        assert report["rows_out"] == {"A": 931, "B": 150, "C": 1873}[t]
    return out


def test_scan_prunes_columns(spark, fact):
    df = billing.projected_scan(billing.parquet_scan(spark, fact), ["volfac", "absent"])
    assert df.columns == ["volfac"]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<volfac:double>" in plan


def test_filter_reaches_the_scan(spark, fact):
    plan = spark.read.parquet(fact).filter("nomdis = 'NATION_7'").select("volfac")._jdf.queryExecution()
    assert "EqualTo(nomdis,NATION_7)" in plan.executedPlan().toString()


def test_unit_table_has_one_exchange(spark, fact):
    from aforo.operators.features import features_unit

    plan = features_unit(spark.read.parquet(fact))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_zstd_parquet_and_csv(spark, fact):
    df = spark.read.parquet(fact).select("codcon", "volfac")
    path = sinks.parquet_sink(df, scratch_path(spark, "zstd"))
    assert ".zstd.parquet" in spark.read.parquet(path).inputFiles()[0]
    csv = sinks.csv_sink(df.groupBy("codcon").count(), scratch_path(spark, "csv"))
    assert spark.read.option("header", True).csv(csv).columns == ["codcon", "count"]


def test_cluster_job(spark, tables):
    target, assigned = scratch_path(spark, "k-result"), scratch_path(spark, "k-rows")
    doc = jobs.train_clusters(spark, tables["B"], "B", target, assigned, n_init=1).first()
    assert 2 <= doc["best_k"] <= 8
    assert len(doc["cluster_profiles"]) == doc["best_k"]
    assert doc["n_samples"] == spark.read.parquet(assigned).count()
    assert spark.read.json(target).first()["dataset"] == "B"


def test_minibatch_job(spark, tables):
    target, assigned, work = (scratch_path(spark, n) for n in ("m-result", "m-rows", "m-work"))
    features = scratch_path(spark, "m-features")
    spark.read.parquet(tables["B"]).repartition(3).write.parquet(features)
    doc = jobs.train_minibatch_clusters(spark, features, "B", target, assigned, work).first()
    rows = spark.read.parquet(assigned)
    assert 2 <= doc["best_k"] <= 8 and len(doc["silhouette_scores"]) == 7
    assert doc["n_samples"] == rows.count() == spark.read.parquet(features).dropna(subset=doc["features"]).count()
    sizes = {str(r["cluster"]): r["count"] for r in rows.groupBy("cluster").count().collect()}
    assert {k: int(v["n"]) for k, v in doc["cluster_profiles"].items()} == sizes
    stored = spark.read.json(target).first()
    assert (stored["modelo"], stored["mode"], stored["dataset"]) == ("MiniBatchKMeans", "streaming", "B")
    state = spark.read.parquet(f"{work}/centres")
    assert state.select("batch").distinct().count() <= 2
    # three batches: every complete row moved a centre once
    weights = state.filter("batch = 2").agg({"weight": "sum"}).first()[0]
    assert weights == doc["n_samples"]


def test_anomaly_job(spark, tables):
    target, flagged = scratch_path(spark, "i-result"), scratch_path(spark, "i-rows")
    doc = jobs.find_anomalies(spark, tables["A"], "A", target, flagged).first()
    assert doc["n_anomalias"] == spark.read.parquet(flagged).count()
    assert {"codudu", "codcon"} <= set(spark.read.parquet(flagged).columns)
    assert abs(doc["pct_anomalias"] - 1.0) < 0.5
    assert set(doc["comparison"]) == {
        "consumo_promedio", "consumo_std", "tarifa_efectiva", "score_calidad", "coef_variacion"
    }


def test_regression_job(spark, tables):
    target = scratch_path(spark, "r-result")
    doc = jobs.train_regression(spark, tables["C"], "C", target, maxIter=3).first()
    assert doc["n_train"] + doc["n_test"] == 1873
    assert set(doc["metricas"].asDict()) == {"rmse", "mae", "r2"}
    assert doc["parametros"]["maxIter"] == "3"
    assert len(doc["feature_importance"]) == 8


def test_alert_job(spark, tables):
    target = scratch_path(spark, "alerts")
    report = jobs.alert_deviations(spark, tables["C"], target, tolerance=0.2, folds=2, maxIter=2).first()
    alerts = spark.read.parquet(target)
    assert report["n"] == 1873 and 0 < report["n_alertas"] == alerts.count() < 1873
    assert alerts.filter("desviacion <= 0.2").count() == 0
    assert {"coddis", "nuanio", "nummes", "fold", "prediction"} <= set(alerts.columns)


def test_series_job_and_report(spark, tables):
    folder = scratch_path(spark, "series")
    jobs.analyse_series(spark, tables["C"], folder, name="NATION_7")
    doc = spark.read.schema(results.SERIES_RESULT_SCHEMA).json(folder).first()
    assert [e["nombre"] for e in doc["analisis"]][0].startswith(("TOTAL", "NATION_7"))
    assert len(doc["analisis"]) == 2
    report = jobs.seasonal_report(spark, folder).first()
    assert report["nombre"].startswith("TOTAL")
    assert report["valor_max"] == max(report["patron"])
    assert report["patron"][report["mes_max"] - 1] == report["valor_max"]


def test_result_defaults(spark, tmp_path):
    file = tmp_path / "resultados_1.json"
    file.write_text(
        '{"modelo": "m",\n "analisis": [{"nombre": "X"}, {"nombre": "Total general", "media": 3.0,'
        ' "patron_mensual": {"2": 5.0}}, {"nombre": "TOTAL 2"}]}'
    )
    row = results.seasonal_extremes(results.result_json_read(spark, str(file))).first()
    assert (row["nombre"], row["media"], row["std"], row["adf_pvalue"]) == ("Total general", 3.0, 0.0, 1.0)
    assert (row["mes_max"], row["valor_max"], row["mes_min"]) == (2, 5.0, 1)


def test_no_results(spark, tmp_path):
    (tmp_path / "empty").mkdir()
    with pytest.raises(FileNotFoundError):
        jobs.seasonal_report(spark, str(tmp_path / "empty"))


def test_causal_jobs(spark, fact):
    events, did = scratch_path(spark, "events"), scratch_path(spark, "did")
    jobs.build_panels(spark, fact, events, did, allow_short=True)
    target, csv = scratch_path(spark, "effects"), scratch_path(spark, "pre")
    effects = {r["term"]: r for r in jobs.estimate_effects(spark, events, did, target, csv).collect()}
    assert {"intercept", "treated", "post", "treated_post", "hoxdia", "diasem"} <= set(effects)
    did_doc = spark.read.json(f"{target}-did").first()
    assert did_doc["coef_names"][:6] == ["intercept", "treated", "post", "treated_post", "hoxdia", "diasem"]
    assert did_doc["coef"] == [effects[t]["coef"] for t in did_doc["coef_names"]] and len(effects) == len(did_doc["coef"])
    assert did_doc["std_error"][3] == effects["treated_post"]["std_error"] and did_doc["n_obs"] == effects["post"]["n_obs"]
    assert did_doc["covariables"]["categoricas"] == ["coddis", "codcat", "codtis", "codmof"]
    assert set(did_doc.asDict()) == {"modelo", "timestamp", "n_obs", "n_clusters", "coef_names", "coef", "std_error", "t_stat", "r2", "notes", "covariables"}
    doc = spark.read.json(target)
    assert {r["covariables"]["tendencia"] for r in doc.collect()} == {"mes_abs"}
    assert all(r["coef"]["baseline"] == r["baseline"] for r in doc.collect())
    assert {r["event_type"] for r in doc.select("event_type").collect()} == {"1to2", "2to1"}
    plan = spark.read.parquet(events).filter("event_type = '1to2'")._jdf.queryExecution()
    assert "PartitionFilters: [isnotnull(event_type" in plan.executedPlan().toString()
