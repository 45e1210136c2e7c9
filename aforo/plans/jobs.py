"""End-to-end jobs over stored tables. Each stores its output and returns a small report."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aforo import schema as S
from aforo.functions.rows import drop_null_rows, select_features
from aforo.operators import clusters, impact, isolation, panel, regression, series, trees
from aforo.operators.encode import apply_scaling
from aforo.operators.features import features_connection, features_district_month, features_unit
from aforo.session import configure, scratch_path, stored_for_passes
from aforo.sources import results
from aforo.sources.billing import sample_rows
from aforo.sources.sinks import csv_sink, parquet_sink, result_json_sink, sink_verify
from aforo.streaming import incremental

SAMPLE_FOR_K = 50_000
BUILDERS = {"A": features_unit, "B": features_connection, "C": features_district_month}


def build_features(spark: SparkSession, source: str, table: str, target: str, **options) -> DataFrame:
    """Feature table A, B or C from the billing table, stored and counted back."""
    configure(spark)
    fact = spark.read.parquet(source)
    parquet_sink(BUILDERS[table](fact, **options), target)
    return sink_verify(spark, target, fact)


def train_regression(
    spark: SparkSession, features: str, table: str, target: str, sampled: bool = False, **overrides
) -> DataFrame:
    """Boosted trees on a stored feature table; writes and returns the result document."""
    fit_one = trees.boosted_trees_sampled if sampled else trees.boosted_trees
    fit = fit_one(spark.read.parquet(features), table, **overrides)
    importances = trees.split_counts(fit, spark) if sampled else trees.feature_importance(fit, spark)
    params = {**(trees.BOOSTED_SAMPLED if sampled else trees.BOOSTED), **overrides}
    document = results.metrics_document(
        trees.regression_metrics(fit.predictions),
        importances,
        "Boosted trees, sampled" if sampled else "Boosted trees",
        table,
        fit.n_train,
        params,
    )
    result_json_sink(document, target)
    return document


def train_clusters(
    spark: SparkSession, features: str, table: str, target: str, assignments: str, n_init: int = clusters.N_INIT
) -> DataFrame:
    """Choose k, segment, store the assignments and the result document."""
    keys = S.FEATURE_TABLE_KEYS[table]
    wanted = S.CLUSTER_FEATURES[table]
    df = select_features(spark.read.parquet(features), table, "clustering", keys)
    vectors = stored_for_passes(clusters.scaled_vectors(df, wanted), "vectors", keys).persist()
    scores = clusters.best_k_search(vectors, keys, n_init=n_init).persist()
    best = max(scores.collect(), key=lambda r: (r["silhouette"], -r["k"]))["k"]
    model = clusters.kmeans(vectors, best, n_init=n_init)
    parquet_sink(model.transform(vectors).drop("zvec"), assignments)
    vectors.unpersist()
    profiles = clusters.cluster_profiles(spark.read.parquet(assignments), wanted)
    document = results.profiles_document(profiles, scores, table, "K-Means Clustering")
    result_json_sink(document, target)
    return document


def train_minibatch_clusters(
    spark: SparkSession, features: str, table: str, target: str, assignments: str, work: str | None = None,
    files_per_batch: int = 1, sample_for_k: int = SAMPLE_FOR_K, n_init: int = 1,
    k_min: int = clusters.K_MIN, k_max: int = clusters.K_MAX,
) -> DataFrame:
    """Segment a stored feature table batch by batch; stores assignments and the result document.

    A first streaming query fits the scaler. k is chosen on a drawn sample of
    ``sample_for_k`` scaled rows, which also gives the start centres. A second
    streaming query moves the centres, and a plain pass assigns every row and
    profiles the clusters. With the same ``work`` folder a job that was stopped
    goes on after the last batch it finished.
    """
    configure(spark)
    keys, wanted = S.FEATURE_TABLE_KEYS[table], S.CLUSTER_FEATURES[table]
    work = (work or scratch_path(spark, "minibatch")).rstrip("/")
    rows = spark.read.parquet(features)
    columns = [f"z_{f}" for f in wanted]

    def stream() -> DataFrame:
        return incremental.stream_table(spark, features, rows.schema, files_per_batch)

    scaler = incremental.standardise_incremental(stream(), wanted, f"{work}/scaler", f"{work}/scaler-stream")
    scales = incremental.scales_of(scaler, wanted)
    complete = drop_null_rows(rows.select(*keys, *[f for f in wanted if f not in keys]), wanted)
    sample = apply_scaling(sample_rows(complete, sample_for_k, keys), scales).persist()
    try:
        vectors = VectorAssembler(inputCols=columns, outputCol="zvec").transform(sample)
        scores = clusters.best_k_search(vectors, keys, k_min, k_max, n_init)
        best = max(scores.collect(), key=lambda r: (r["silhouette"], -r["k"]), default=None)  # one row per k
        if best is None:
            raise ValueError(f"too few complete rows to choose from {k_min} clusters or more")
        start = clusters.start_centres(sample, columns, best["k"], keys)
    finally:
        sample.unpersist()
    state = incremental.minibatch_kmeans(stream(), wanted, scales, start, f"{work}/centres", f"{work}/centres-stream")
    centres = [r["centre"] for r in state.orderBy("cluster").collect()]  # k x d numbers
    labelled = clusters.assign_clusters(apply_scaling(complete, scales), columns, centres).drop(*columns)
    parquet_sink(labelled, assignments)
    profiles = clusters.cluster_profiles(spark.read.parquet(assignments), wanted)
    document = results.profiles_document(
        profiles, scores, table, "MiniBatchKMeans", features=wanted, mode="streaming", files_per_batch=files_per_batch
    )
    result_json_sink(document, target)
    return document


def find_anomalies(
    spark: SparkSession, features: str, table: str, target: str, anomalies: str,
    contamination: float = isolation.CONTAMINATION,
) -> DataFrame:
    """Score every row, store the flagged ones with their whole key, and the result document."""
    keys, wanted = S.FEATURE_TABLE_KEYS[table], S.ANOMALY_FEATURES[table]
    flagged = isolation.detect_anomalies(spark.read.parquet(features), wanted, keys, contamination)
    parquet_sink(flagged.filter("es_anomalia"), anomalies)
    document = results.anomalies_document(
        isolation.anomaly_comparison(flagged, wanted), table, contamination
    )
    result_json_sink(document, target)
    return document


def alert_deviations(
    spark: SparkSession, districts: str, target: str, tolerance: float = 0.10, folds: int = 5, **overrides
) -> DataFrame:
    """District-months whose consumption is off a prediction made without them; stored with the prediction.

    Returns a report row: rows predicted, alerts and the error of the predictions.
    """
    predictions = trees.out_of_fold(spark.read.parquet(districts), "C", folds, **overrides)
    parquet_sink(impact.deviation_alerts(predictions, S.TARGET, "prediction", tolerance), target)
    alerts = spark.read.parquet(target).agg(F.count(F.lit(1)).alias("n_alertas"))
    return trees.regression_metrics(predictions).crossJoin(alerts)  # one row each


def analyse_series(spark: SparkSession, districts: str, target: str, name: str | None = None) -> DataFrame:
    """Total series and one named or the five largest districts."""
    table = spark.read.parquet(districts)
    chosen = series.series_select(series.district_series(table), name)
    both = series.total_as_series(table).unionByName(chosen)
    document = results.series_result(series.series_document(both))
    result_json_sink(document, target)
    return document


def seasonal_report(spark: SparkSession, folder: str) -> DataFrame:
    """The newest series result of a folder, reduced to the total and its extremes."""
    newest = results.latest_result(spark, folder).first()
    if newest is None:
        raise FileNotFoundError(folder)
    return results.seasonal_extremes(results.result_json_read(spark, newest["file_path"]))


def build_panels(
    spark: SparkSession, source: str, event_target: str, did_target: str, allow_short: bool = False
) -> None:
    """Event panel, partitioned by event type, and the difference-in-differences panel."""
    configure(spark)
    fact = spark.read.parquet(source)
    events, did = panel.both_panels(fact, allow_short=allow_short)
    events.write.partitionBy("event_type").option("compression", "zstd").parquet(event_target)
    parquet_sink(did, did_target)


def estimate_effects(
    spark: SparkSession, event_panel: str, did_panel: str, target: str, pretrends_csv: str, did_target: str | None = None
) -> DataFrame:
    """Event studies, difference-in-differences and the pre-trend table, with their result documents.

    The difference-in-differences document goes to ``did_target``, without it to
    ``target`` with ``-did`` behind.
    """
    did = spark.read.parquet(did_panel)
    csv_sink(panel.pretrend_pivot(did), pretrends_csv)
    study = regression.event_study(spark.read.parquet(event_panel))
    result_json_sink(results.event_study_document(study), target)
    effects = regression.did_ols_cluster(did)
    numerics = [c for c in S.PANEL_NUMERIC if c in did.columns]
    categorical = [c for c in S.PANEL_CATEGORICAL if c in did.columns]
    result_json_sink(results.did_document(effects, categorical, numerics), did_target or f"{target.rstrip('/')}-did")
    return effects
