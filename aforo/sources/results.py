"""Result documents: building, finding the latest, reading back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aforo import schema as S

DEFAULTS = {
    "media": 0.0,
    "std": 0.0,
    "min": 0.0,
    "max": 0.0,
    "tendencia_inicio": 0.0,
    "tendencia_fin": 0.0,
    "tendencia_cambio_pct": 0.0,
    "estacionalidad_amplitud": 0.0,
    "adf_pvalue": 1.0,
}

SERIES_RESULT_SCHEMA = (
    "modelo string, timestamp string, analisis array<struct<nombre: string, n_puntos: bigint, "
    "media: double, std: double, min: double, max: double, adf_statistic: double, adf_pvalue: double, "
    "es_estacionaria: string, tendencia_inicio: double, tendencia_fin: double, "
    "tendencia_cambio_pct: double, estacionalidad_max: double, estacionalidad_min: double, "
    "estacionalidad_amplitud: double, patron_mensual: map<string, double>>>"
)


def result_document(payload: DataFrame, model: str, dataset: str) -> DataFrame:
    """One-row result with model, dataset and time in front of the payload columns."""
    return payload.select(
        F.lit(model).alias("modelo"),
        F.lit(dataset).alias("dataset"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
        "*",
    )


def metrics_document(
    metrics: DataFrame, importances: DataFrame, model: str, dataset: str, n_train: int, params: dict
) -> DataFrame:
    """Result of a regression run: metrics struct, importance map, parameter map."""
    ranked = {r["feature"]: float(r[1]) for r in importances.collect()}  # one row per feature
    payload = metrics.select(
        F.struct("rmse", "mae", "r2").alias("metricas"),
        F.lit(n_train).alias("n_train"),
        F.col("n").alias("n_test"),
        _literal_map(ranked).alias("feature_importance"),
        _literal_map({k: str(v) for k, v in params.items()}).alias("parametros"),
    )
    return result_document(payload, model, dataset)


def _literal_map(values: dict):
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def profiles_document(profiles: DataFrame, scores: DataFrame, dataset: str, model: str, **more) -> DataFrame:
    """Result of a clustering run: k, silhouette map and one profile map per cluster; ``more`` adds constants."""
    columns = [c for c in profiles.columns if c != "cluster"]
    profile = F.create_map(*[x for c in columns for x in (F.lit(c), F.col(c).cast("double"))])
    by_cluster = profiles.agg(
        F.map_from_entries(
            F.collect_list(F.struct(F.col("cluster").cast("string").alias("k"), profile.alias("v")))
        ).alias("cluster_profiles"),
        F.sum("n").alias("n_samples"),
    )
    found = {r["k"]: r["silhouette"] for r in scores.collect()}  # one row per k
    best_k = max(found, key=lambda k: (found[k], -k))
    payload = by_cluster.select(
        F.lit(best_k).alias("best_k"),
        F.lit(found[best_k]).alias("best_silhouette"),
        _literal_map({str(k): v for k, v in found.items()}).alias("silhouette_scores"),
        "*",
        *[F.lit(v).alias(name) for name, v in more.items()],
    )
    return result_document(payload, model, dataset)


def anomalies_document(comparison: DataFrame, dataset: str, contamination: float) -> DataFrame:
    """Result of an anomaly run: counts and a comparison struct per feature."""
    entry = F.struct("normal", "anomalia", "ratio")
    payload = comparison.groupBy("n_total", "n_anomalias", "pct_anomalias").agg(
        F.map_from_entries(F.collect_list(F.struct("feature", entry))).alias("comparison")
    )
    return result_document(
        payload.withColumn("contamination", F.lit(contamination)), "Isolation Forest", dataset
    )


def series_result(documents: DataFrame) -> DataFrame:
    """All series entries in one document."""
    body = documents.agg(F.collect_list(F.struct("*")).alias("analisis"))
    return result_document(body, "Series Temporales", "C").drop("dataset")


def _covariates(categorical: Sequence[str], numerics: Sequence[str], **more: str):
    """The ``covariables`` block: what the regression controls for."""
    names = lambda values: F.array(*[F.lit(v) for v in values]).cast("array<string>")
    return F.struct(
        names(categorical).alias("categoricas"), names(numerics).alias("numericas"), *[F.lit(v).alias(k) for k, v in more.items()]
    ).alias("covariables")


def did_document(
    coefficients: DataFrame,
    categorical: Sequence[str] = tuple(S.PANEL_CATEGORICAL),
    numerics: Sequence[str] = tuple(S.PANEL_NUMERIC),
    model: str = "DiD OLS covariables + cluster SE",
    notes: str = "treated_post es el efecto DiD. SE cluster por codcon+codudu.",
) -> DataFrame:
    """The difference-in-differences regression as one row: names and figures as arrays in the order of the design."""
    rows = coefficients.collect()  # one row per term
    arrays = {c: [r[c] for r in rows] for c in ("term", "coef", "std_error", "t_stat")}
    first = rows[0]
    one = coefficients.sparkSession.createDataFrame(
        [(first["n_obs"], first["n_clusters"], *arrays.values(), first["r2"], notes)],
        "n_obs long, n_clusters long, coef_names array<string>, coef array<double>, std_error array<double>, t_stat array<double>, "
        "r2 double, notes string",
    )
    return result_document(one.select("*", _covariates(categorical, numerics)), model, "").drop("dataset")


def event_study_document(
    coefficients: DataFrame,
    categorical: Sequence[str] = tuple(S.PANEL_CATEGORICAL),
    numerics: Sequence[str] = tuple(S.PANEL_NUMERIC),
    trend: str = "mes_abs",
) -> DataFrame:
    """One document per event type: coefficient, error and t maps by relative month, and the covariates."""
    effects = coefficients.filter((F.col("term") == "intercept") | F.col("t_rel").isNotNull())
    key = F.coalesce(F.col("t_rel").cast("string"), F.col("term"))

    def by_time(column: str):
        return F.map_from_entries(F.collect_list(F.struct(key.alias("k"), F.col(column).alias("v"))))

    maps = effects.groupBy("event_type", "baseline", "n_obs", "n_clusters", "r2").agg(
        F.array_sort(F.collect_set("t_rel")).alias("t_vals"),
        by_time("coef").alias("coef"),
        by_time("std_error").alias("std_error"),
        by_time("t_stat").alias("t_stat"),
    )
    with_base = F.map_concat("coef", F.create_map(F.lit("baseline"), F.col("baseline").cast("double")))
    return maps.withColumn("coef", with_base).select("*", _covariates(categorical, numerics, tendencia=trend))


def latest_result(spark: SparkSession, folder: str) -> DataFrame:
    """Path and time of the newest result file of a folder."""
    # only the listing is read, no content
    files = spark.read.format("binaryFile").load(folder).select(
        F.col("path").alias("file_path"), F.col("modificationTime").alias("modified")
    )
    newest = F.max(F.struct("modified", "file_path"))
    return files.agg(newest.alias("f")).select("f.file_path", "f.modified").filter(
        F.col("file_path").isNotNull()
    )


def result_json_read(spark: SparkSession, path: str) -> DataFrame:
    """The total series of a series result, with defaults for missing fields and months 1..12."""
    documents = spark.read.schema(SERIES_RESULT_SCHEMA).option("multiLine", True).json(path).select(
        "analisis", F.col("_metadata.file_modification_time").alias("at"), F.col("_metadata.file_path").alias("file")
    )
    entries = documents.select("at", "file", F.posexplode("analisis").alias("pos", "e")).filter(
        F.upper("e.nombre").startswith("TOTAL")
    )
    # of several documents the newest, in it the first entry
    place = F.struct(-F.unix_micros("at"), "file", "pos")
    first = entries.agg(F.min_by("e", place).alias("e")).filter(F.col("e").isNotNull())
    months = F.transform(
        F.sequence(F.lit(1), F.lit(12)),
        lambda m: F.coalesce(F.try_element_at("e.patron_mensual", m.cast("string")), F.lit(0.0)),
    )
    return first.select(
        "e.nombre",
        *[F.coalesce(f"e.{c}", F.lit(d)).alias(c) for c, d in DEFAULTS.items()],
        months.alias("patron"),
    )


def seasonal_extremes(total: DataFrame) -> DataFrame:
    """Peak and trough month of the twelve seasonal values; the first on ties."""
    top, low = F.array_max("patron"), F.array_min("patron")
    return total.withColumns(
        {
            "mes_max": F.array_position("patron", top).cast("int"),
            "valor_max": top,
            "mes_min": F.array_position("patron", low).cast("int"),
            "valor_min": low,
        }
    )
