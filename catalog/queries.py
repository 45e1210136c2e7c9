"""One query per operator over the driver's tables.

Results are rounded, because sums of doubles depend on the order of addition.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from aforo import schema as S
from aforo.functions import measures as M
from aforo.functions import rows as R
from aforo.operators import aggregates as A
from aforo.operators import clusters as K
from aforo.operators import encode as E
from aforo.operators import features as FT
from aforo.operators import impact as I
from aforo.operators import isolation as IF
from aforo.operators import panel as P
from aforo.operators import quantiles as Q
from aforo.operators import regression as G
from aforo.operators import series as T
from aforo.operators import trees as B
from aforo.session import scratch_path, stored_for_passes
from aforo.sources import billing, results, sinks
from aforo.streaming import incremental as INC
from catalog.fixture import consumo, table

Query = Callable[[SparkSession, str], DataFrame]
TEXT_SAMPLE = 200
QUERIES: dict[str, Query] = {}

CENTROIDS = [[-1.0] * 5, [0.0] * 5, [1.0] * 5]
FIXED_CENTRES = {k: [[2.0 * i / (k - 1) - 1.0] * 5 for i in range(k)] for k in (2, 3, 5)}
EVENT_YEAR = 1998
TARIFF = 5.0
SAMPLE = 1_000
SHIFT = 0.0173
#: Files that one streaming batch takes where they are small.
SMALL_FILES = 256


def register(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to a fixed number of decimals, without negative zero.

    A short decimal can lie exactly on a rounding boundary, where engines
    differ; a small shift moves it off, here and in the SQL.
    """
    shift = F.lit(SHIFT * 10.0**-digits)
    return df.select(
        *[
            (F.round(F.col(f.name) + shift, digits) + 0.0).alias(f.name) if isinstance(f.dataType, DoubleType) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def units(spark, sf) -> DataFrame:
    return FT.features_unit(consumo(spark, sf))


def connections(spark, sf) -> DataFrame:
    return FT.features_connection(consumo(spark, sf))


def districts(spark, sf) -> DataFrame:
    return FT.features_district_month(consumo(spark, sf))


def demand(spark, sf) -> DataFrame:
    return FT.district_demand(consumo(spark, sf))


def stored(spark, df: DataFrame, name: str) -> DataFrame:
    """A written table for what is read several times: in use, these tables live on disk."""
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.parquet(path)


def did_panel(spark, sf) -> DataFrame:
    return stored(spark, P.did_panel(consumo(spark, sf), allow_short=True), "did-panel")


def event_study_panel(spark, sf) -> DataFrame:
    path = scratch_path(spark, "event-panel")
    P.event_study_panel(consumo(spark, sf)).write.partitionBy("event_type").parquet(path)
    return spark.read.parquet(path)


def series_of(spark, sf) -> DataFrame:
    return T.districts_and_total(demand(spark, sf))


# ---- sources and sinks ----


@register
def parquet_scan(spark, sf):
    return billing.parquet_scan(spark, f"{sf}/customer.parquet")


@register
def projected_scan(spark, sf):
    return billing.projected_scan(
        table(spark, sf, "lineitem"), ["l_orderkey", "l_quantity", "l_returnflag", "not_there"]
    )


@register
def row_count(spark, sf):
    return billing.row_count(consumo(spark, sf))


@register
def limit_rows(spark, sf):
    keys = consumo(spark, sf).select(*S.UNIT_KEYS).distinct()
    return billing.limit_rows(keys, SAMPLE, S.UNIT_KEYS)


@register
def sample_rows(spark, sf):
    keys = stored(spark, consumo(spark, sf).select(*S.UNIT_KEYS).distinct(), "unit-keys")
    return billing.sample_rows(keys, SAMPLE, S.UNIT_KEYS)


@register
def parquet_sink(spark, sf):
    path = scratch_path(spark, "connections")
    sinks.parquet_sink(connections(spark, sf), path)
    return rounded(spark.read.parquet(path))


@register
def sink_verify(spark, sf):
    fact = consumo(spark, sf)
    path = scratch_path(spark, "unit-keys")
    sinks.parquet_sink(fact.groupBy(*S.UNIT_KEYS).count(), path)
    return rounded(sinks.sink_verify(spark, path, fact))


@register
def csv_sink(spark, sf):
    path = scratch_path(spark, "pretrends")
    sinks.csv_sink(P.pretrend_pivot(P.did_panel(consumo(spark, sf), allow_short=True)), path)
    stored = spark.read.option("header", True).schema("t_rel int, `0` double, `1` double").csv(path)
    return rounded(stored.withColumnsRenamed({"0": "control", "1": "treated"}))


@register
def result_json_sink(spark, sf):
    path = scratch_path(spark, "series-result")
    sinks.result_json_sink(results.series_result(T.series_document(series_of(spark, sf))), path)
    stored = spark.read.schema(results.SERIES_RESULT_SCHEMA).json(path)
    entry = stored.select(F.explode("analisis").alias("e"))
    return rounded(
        entry.select(
            "e.nombre", "e.n_puntos", "e.media", "e.std", "e.tendencia_inicio", "e.tendencia_fin",
            "e.estacionalidad_amplitud", F.size("e.patron_mensual").cast("long").alias("n_meses"),
        ), 4,
    )


@register
def latest_result(spark, sf):
    folder = scratch_path(spark, "runs")
    fact = consumo(spark, sf)
    for name, rows in (("first", fact.filter("situdu = '1'")), ("second", fact)):
        sinks.result_json_sink(rows.agg(F.lit(name).alias("run"), F.sum("volfac").alias("total")), folder)
    newest = results.latest_result(spark, folder).first()["file_path"]
    return rounded(spark.read.schema("run string, total double").json(newest), 2)


@register
def result_json_read(spark, sf):
    path = scratch_path(spark, "series-result")
    total = T.total_as_series(demand(spark, sf))
    sinks.result_json_sink(results.series_result(T.series_document(total)), path)
    read = results.seasonal_extremes(results.result_json_read(spark, path))
    return rounded(
        read.select(
            "nombre", "media", "std", "min", "max", "tendencia_inicio", "tendencia_fin",
            "tendencia_cambio_pct", "estacionalidad_amplitud", "mes_max", "valor_max", "mes_min", "valor_min",
        ), 4,
    )


# ---- scalar expressions and filters ----


@register
def cast_measures(spark, sf):
    return rounded(M.cast_measures(consumo(spark, sf)).select("codudu", "codcon", *M.MEASURES.values()))


@register
def season(spark, sf):
    return consumo(spark, sf).groupBy("nummes", M.season("nummes").alias("estacion")).agg(
        F.count(F.lit(1)).alias("n")
    )


@register
def month_index(spark, sf):
    return consumo(spark, sf).groupBy(
        "nuanio", "nummes",
        M.month_index("nuanio", "nummes", S.BASE_YEAR).alias("mes_absoluto"),
        M.month_index("nuanio", "nummes").alias("mes"),
    ).agg(F.count(F.lit(1)).alias("n"))


@register
def safe_ratio(spark, sf):
    base = M.cast_measures(consumo(spark, sf))
    return rounded(
        base.select(
            "codudu",
            M.safe_ratio("importe_agua", "consumo").alias("tarifa"),
            M.safe_ratio("importe_alc", "importe_agua", "nonzero").alias("alc_por_agua"),
        )
    )


@register
def service_quality(spark, sf):
    base = M.cast_measures(consumo(spark, sf))
    return rounded(base.groupBy("coddis").agg(F.avg(M.service_quality()).alias("score_calidad")))


@register
def bill_total(spark, sf):
    base = M.cast_measures(consumo(spark, sf))
    return rounded(base.groupBy("codcon").agg(F.sum(M.bill_total()).alias("importe_total")))


@register
def subsidy_flag(spark, sf):
    return consumo(spark, sf).groupBy("situdu", M.subsidy_flag().alias("es_subsidiado")).agg(
        F.count(F.lit(1)).alias("n")
    )


@register
def size_bucket(spark, sf):
    n = A.distinct_counts(consumo(spark, sf), ["codcon"], {"codudu": "num_unidades_uso"})
    return n.withColumn("tipo_predio", M.size_bucket("num_unidades_uso"))


@register
def share_pct(spark, sf):
    counts = consumo(spark, sf).groupBy("coddis").agg(
        F.count(F.lit(1)).alias("n"), A.conditional_count(F.col("situdu") == "1").alias("n_subsidiados")
    )
    return rounded(counts.withColumn("pct_subsidiado", M.share_pct("n_subsidiados", "n")))


@register
def derived_spread(spark, sf):
    base = M.cast_measures(consumo(spark, sf))
    lim = base.groupBy("codcon").agg(F.max("consumo").alias("mx"), F.min("consumo").alias("mn"))
    return rounded(lim.select("codcon", M.spread("mx", "mn").alias("consumo_rango")))


@register
def filter_eq(spark, sf):
    return rounded(
        R.filter_eq(consumo(spark, sf), "nomdis", "NATION_7").select("codudu", "nuanio", "nummes", "volfac")
    )


@register
def filter_lt(spark, sf):
    panel = P.event_study_panel(consumo(spark, sf))
    return R.filter_lt(panel, "t_rel", 0).groupBy("event_type", "t_rel").agg(F.count(F.lit(1)).alias("n"))


@register
def drop_null_rows(spark, sf):
    cols = ["consumo_std", "consumo_verano", "consumo_invierno"]
    return rounded(R.drop_null_rows(units(spark, sf), cols).select(*S.UNIT_KEYS, *cols))


@register
def select_features(spark, sf):
    return rounded(R.select_features(connections(spark, sf), "B", "regression", ["codcon"]))


# ---- aggregations ----


@register
def features_unit(spark, sf):
    return rounded(units(spark, sf))


@register
def features_unit_large_groups(spark, sf):
    """The same table with every unit of 20 records or more on the large-group path."""
    return rounded(FT.features_unit(consumo(spark, sf), hot_rows=20))


@register
def features_connection(spark, sf):
    return rounded(connections(spark, sf))


@register
def features_district_month(spark, sf):
    return rounded(districts(spark, sf))


@register
def moments(spark, sf):
    base = M.cast_measures(consumo(spark, sf))
    return rounded(base.groupBy("coddis").agg(*A.moments("consumo", "consumo"), A.record_count("n")))


@register
def coef_variation(spark, sf):
    return rounded(A.coef_variation(consumo(spark, sf), ["coddis", "codcat"], "volfac"))


QUARTILES = {"mediana": 0.5, "p25": 0.25, "p75": 0.75, "p95": 0.95}


@register
def exact_quantiles(spark, sf):
    return rounded(Q.group_quantiles(consumo(spark, sf), ["coddis", "nuanio"], "imagua", QUARTILES))


@register
def exact_quantiles_large_groups(spark, sf):
    """Every group on the large-group path; the answer is the same."""
    return rounded(Q.group_quantiles(consumo(spark, sf), ["coddis"], "imagua", QUARTILES, hot_rows=10))


@register
def nearest_quantiles(spark, sf):
    fact = consumo(spark, sf)
    return rounded(Q.group_quantiles(fact, ["coddis"], "imagua", QUARTILES, method="nearest"))


@register
def approximate_quantiles(spark, sf):
    return rounded(Q.approximate_quantiles(consumo(spark, sf), ["coddis"], "imagua", QUARTILES))


@register
def distinct_counts(spark, sf):
    return A.distinct_counts(
        consumo(spark, sf), ["coddis"],
        {"codudu": "n_unidades", "codcon": "n_conexiones", "nuanio": "n_anios", "codcat": "n_categorias"},
    )


@register
def approximate_distinct_counts(spark, sf):
    return A.approximate_distinct_counts(consumo(spark, sf), ["coddis"], {"codudu": "n_unidades"})


@register
def representative(spark, sf):
    cols = ["nomdis", "codcat", "situdu"]
    first = consumo(spark, sf).groupBy("codcon").agg(A.representative(["nuanio", "nummes"], cols).alias("f"))
    return first.select("codcon", *[f"f.{c}" for c in cols])


@register
def conditional_mean(spark, sf):
    base = M.cast_measures(consumo(spark, sf)).withColumn("estacion", M.season("nummes"))
    return rounded(
        base.groupBy("codcon").agg(
            A.conditional_mean("consumo", F.col("estacion") == S.SUMMER).alias("consumo_verano"),
            A.conditional_mean("consumo", F.col("estacion") == S.WINTER).alias("consumo_invierno"),
        )
    )


@register
def conditional_count(spark, sf):
    return consumo(spark, sf).groupBy("coddis", "nuanio").agg(
        A.conditional_count(F.col("codcat") == "102").alias("n_domestico"),
        A.conditional_count(F.col("codcat") == "103").alias("n_comercial"),
        A.conditional_count(F.col("codcat") == "104").alias("n_industrial"),
        A.conditional_count(F.col("situdu") == "1").alias("n_subsidiados"),
    )


@register
def effective_tariff(spark, sf):
    base = M.cast_measures(consumo(spark, sf))
    sums = base.groupBy("coddis").agg(
        F.avg(M.safe_ratio("importe_agua", "consumo")).alias("media_de_razones"),
        F.sum(M.bill_total()).alias("f"), F.sum("consumo").alias("d"),
    )
    return rounded(sums.select("coddis", "media_de_razones", M.safe_ratio("f", "d").alias("razon_de_sumas")))


@register
def size_distribution(spark, sf):
    return A.size_distribution(connections(spark, sf))


@register
def coverage_stats(spark, sf):
    return A.coverage_stats(demand(spark, sf))


@register
def top_districts(spark, sf):
    return rounded(A.top_districts(demand(spark, sf)), 4)


@register
def total_series(spark, sf):
    return rounded(A.total_series(demand(spark, sf)), 4)


@register
def distinct_values(spark, sf):
    levels = A.distinct_values(consumo(spark, sf), S.PANEL_CATEGORICAL)
    parts = [levels.select(F.lit(c).alias("columna"), F.explode(F.col(c).cast("array<string>")).alias("nivel"))
             for c in S.PANEL_CATEGORICAL]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@register
def pivot_mean(spark, sf):
    panel = P.did_panel(consumo(spark, sf), allow_short=True)
    return rounded(P.pivot_mean(panel, "t_rel", "treated", [0, 1], "volfac", "treated_"))


# ---- panels ----


@register
def first_transition(spark, sf):
    history = P.unit_history(consumo(spark, sf))
    parts = [P.events_of(history, d).withColumn("tipo", F.lit(d)) for d in ("1to2", "2to1")]
    return parts[0].unionByName(parts[1])


@register
def never_treated(spark, sf):
    return P.never_treated(consumo(spark, sf))


@register
def sample_controls(spark, sf):
    history = stored(spark, P.unit_history(consumo(spark, sf)), "unit-history")
    return P.sample_controls(P.events_of(history, "1to2"), history.filter("nunca"), ratio=1)


@register
def event_panel(spark, sf):
    panel = P.event_study_panel(consumo(spark, sf))
    return rounded(panel.select("event_type", "codcon", "codudu", "nuanio", "nummes", "t_rel", "volfac"))


@register
def combine_panels(spark, sf):
    panel = P.did_panel(consumo(spark, sf), allow_short=True)
    return rounded(panel.select("codcon", "codudu", "t_rel", "treated", "post", "volfac"))


# ---- time series ----


@register
def centred_moving_average(spark, sf):
    smooth = T.centred_moving_average(series_of(spark, sf))
    return rounded(smooth.select("serie", "nuanio", "nummes", "tendencia"), 4)


@register
def seasonal_component(spark, sf):
    return rounded(T.seasonal_component(series_of(spark, sf)), 4)


@register
def first_last_trend(spark, sf):
    dec = T.seasonal_decompose(series_of(spark, sf))
    return rounded(T.trend_change(dec).select("serie", "tendencia_inicio", "tendencia_fin"), 4)


@register
def series_stats(spark, sf):
    return rounded(T.series_stats(series_of(spark, sf)), 4)


@register
def adf_test(spark, sf):
    return rounded(T.adf_test(series_of(spark, sf)))


@register
def adf_fixed_lag(spark, sf):
    return rounded(T.adf_fixed_lag(series_of(spark, sf)))


@register
def dickey_fuller(spark, sf):
    return rounded(T.dickey_fuller(series_of(spark, sf)))


@register
def seasonal_decompose(spark, sf):
    dec = T.seasonal_decompose(series_of(spark, sf))
    return rounded(dec.select("serie", "nuanio", "nummes", "tendencia", "estacional", "residuo"), 4)


@register
def trend_change(spark, sf):
    return rounded(T.trend_change(T.seasonal_decompose(series_of(spark, sf))), 4)


@register
def seasonal_amplitude(spark, sf):
    return rounded(T.seasonal_amplitude(T.seasonal_decompose(series_of(spark, sf))), 4)


@register
def monthly_pattern(spark, sf):
    return rounded(T.monthly_pattern(T.seasonal_decompose(series_of(spark, sf))), 4)


@register
def complete_months(spark, sf):
    return rounded(T.complete_months(T.district_series(demand(spark, sf))), 4)


@register
def series_select(spark, sf):
    return rounded(T.series_select(T.district_series(demand(spark, sf))), 4)


@register
def peak_trough_month(spark, sf):
    pattern = T.monthly_pattern(T.seasonal_decompose(series_of(spark, sf)))
    return rounded(T.peak_trough_month(pattern), 4)


@register
def seasonal_summary(spark, sf):
    return rounded(T.seasonal_summary(series_of(spark, sf), with_test=False), 4)


# ---- sorts and top-k ----


@register
def sort_multi(spark, sf):
    return rounded(A.sort_multi(demand(spark, sf), "coddis", "nuanio", "nummes"))


def scored_units(spark, sf) -> DataFrame:
    """Units with mean consumption as the score to cut."""
    return IF.contamination_cut(stored(spark, units(spark, sf), "units"), "consumo_promedio")


@register
def contamination_cut(spark, sf):
    return rounded(
        scored_units(spark, sf).select(*S.UNIT_KEYS, "consumo_promedio", "anomaly_score", "es_anomalia")
    )


@register
def contamination_cut_large_group(spark, sf):
    """The cut of the billed amounts by the large-group path: all records are one group."""
    cut = Q.group_quantiles(consumo(spark, sf).select("imagua"), [], "imagua", {"cut": 0.99}, hot_rows=1_000)
    return rounded(cut)


@register
def top_anomalies(spark, sf):
    top = IF.top_anomalies(scored_units(spark, sf), S.UNIT_KEYS)
    return rounded(top.select(*S.UNIT_KEYS, "consumo_promedio", "anomaly_score"))


@register
def anomaly_comparison(spark, sf):
    return rounded(IF.anomaly_comparison(scored_units(spark, sf), S.ANOMALY_FEATURES["A"]))


@register
def argmax_k(spark, sf):
    scores = connections(spark, sf).groupBy(F.col("anios_activos").alias("k")).agg(
        F.avg("score_calidad").alias("score")
    )
    return rounded(A.argmax(scores, "k", "score", "best_k"))


# ---- models ----


@register
def label_encode(spark, sf):
    labels = ["distrito", "tipo_predio"]
    rows = stored(spark, connections(spark, sf).select("codcon", *labels), "connections")
    coded = E.label_encode(rows, labels)
    return coded.select(
        "codcon", F.col("distrito_idx").cast("long"), F.col("tipo_predio_idx").cast("long")
    )


@register
def categorical_features(spark, sf):
    wanted = [*S.REGRESSION_CATEGORICAL["C"], *S.REGRESSION_NUMERIC["C"]]
    df = stored(spark, R.drop_null_rows(districts(spark, sf).select(*wanted), S.REGRESSION_NUMERIC["C"]), "districts")
    ready = E.feature_vector(df, S.REGRESSION_CATEGORICAL["C"], S.REGRESSION_NUMERIC["C"], True)
    attrs = ready.schema["features"].metadata["ml_attr"]["attrs"]["nominal"]
    counts = F.create_map(*[F.lit(x) for a in attrs for x in (a["name"], len(a["vals"]))])
    return ready.agg(F.count(F.lit(1)).alias("n")).select("n", F.explode(counts).alias("feature", "n_levels"))


@register
def train_test_split(spark, sf):
    train, test = E.train_test_split(units(spark, sf).select(*S.UNIT_KEYS), S.UNIT_KEYS)
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


@register
def boosted_trees(spark, sf):
    return rounded(B.boosted_trees(districts(spark, sf), "C").predictions, 4)


@register
def boosted_trees_sampled(spark, sf):
    return rounded(B.boosted_trees_sampled(districts(spark, sf), "C").predictions, 4)


@register
def regression_metrics(spark, sf):
    return rounded(B.regression_metrics(units(spark, sf), "consumo_promedio", "consumo_mediana"))


@register
def feature_importance(spark, sf):
    fit = B.boosted_trees(connections(spark, sf), "B", maxIter=20)
    gain = B.feature_importance(fit, spark)
    return rounded(gain.join(B.split_counts(fit, spark), "feature"))


@register
def importance_rank(spark, sf):
    fit = B.boosted_trees(connections(spark, sf), "B", maxIter=20)
    return rounded(B.importance_rank(B.feature_importance(fit, spark)))


def complete_connections(spark, sf, wanted: Sequence[str]) -> DataFrame:
    """Connections complete in the wanted columns, stored: the scaling reads them before the rows are scaled."""
    rows = R.drop_null_rows(connections(spark, sf).select("codcon", *wanted), wanted)
    return stored(spark, rows, "connections")


@register
def standardise(spark, sf):
    wanted = S.CLUSTER_FEATURES["B"]
    return rounded(E.standardise(complete_connections(spark, sf, wanted), wanted).drop(*wanted))


def stored_features(spark, sf, rows_per_file: int) -> tuple[str, DataFrame]:
    path = scratch_path(spark, "feature-stream")
    wanted = S.CLUSTER_FEATURES["B"]
    rows = connections(spark, sf).select("codcon", *wanted)
    rows.write.option("maxRecordsPerFile", rows_per_file).parquet(path)
    return path, spark.read.parquet(path)


@register
def standardise_incremental(spark, sf):
    """Files of 10,000 rows; moments pool exactly, so the stream reads many files at once."""
    path, stored = stored_features(spark, sf, 10_000)
    stream = INC.stream_table(spark, path, stored.schema, files_per_batch=SMALL_FILES)
    state, check = scratch_path(spark, "scaler-state"), scratch_path(spark, "scaler-stream")
    return rounded(INC.standardise_incremental(stream, S.CLUSTER_FEATURES["B"], state, check))


def vectors_of(spark, sf) -> DataFrame:
    wanted = S.CLUSTER_FEATURES["B"]
    return K.scaled_vectors(complete_connections(spark, sf, wanted), wanted)


@register
def kmeans(spark, sf):
    vectors = stored_for_passes(vectors_of(spark, sf), "vectors", ["codcon"]).persist()
    model = K.kmeans(vectors, 3)
    return rounded(K.cluster_profiles(model.transform(vectors), S.CLUSTER_FEATURES["B"]), 4)


@register
def best_k_search(spark, sf):
    return rounded(K.best_k_search(vectors_of(spark, sf), ["codcon"]), 4)


@register
def minibatch_kmeans(spark, sf):
    """Every file of 500 rows is one step; the stream reads many of them at once."""
    wanted = S.CLUSTER_FEATURES["B"]
    path, stored = stored_features(spark, sf, 500)
    scales = E.scaling(R.drop_null_rows(stored, wanted), wanted)
    stream = INC.stream_table(spark, path, stored.schema, files_per_batch=SMALL_FILES, steps=True)
    state, check = scratch_path(spark, "kmeans-state"), scratch_path(spark, "kmeans-stream")
    centres = INC.minibatch_kmeans(stream, wanted, scales, CENTROIDS, state, check)
    return rounded(centres.select("cluster", "weight", F.posexplode("centre").alias("dim", "centre")), 4)


@register
def minibatch_kmeans_one_batch(spark, sf):
    """All files in one batch: each centre becomes the mean of the rows assigned to it."""
    wanted = S.CLUSTER_FEATURES["B"]
    path, stored_rows = stored_features(spark, sf, 500)
    scales = E.scaling(R.drop_null_rows(stored_rows, wanted), wanted)
    stream = INC.stream_table(spark, path, stored_rows.schema, files_per_batch=1_000_000)
    state, check = scratch_path(spark, "kmeans-state"), scratch_path(spark, "kmeans-stream")
    centres = INC.minibatch_kmeans(stream, wanted, scales, CENTROIDS, state, check)
    return rounded(centres.select("cluster", "weight", F.posexplode("centre").alias("dim", "centre")))


@register
def minibatch_kmeans_two_batches(spark, sf):
    """Districts of even number come as one file, the others as a second one: two steps of the centres."""
    wanted = S.CLUSTER_FEATURES["B"]
    rows = stored(spark, connections(spark, sf).select("codcon", "cod_distrito", *wanted), "connections")
    path = scratch_path(spark, "feature-stream")
    for part in (0, 1):
        batch = rows.filter(F.pmod("cod_distrito", F.lit(2)) == part).drop("cod_distrito")
        batch.coalesce(1).write.mode("append").parquet(path)
    stream = INC.stream_table(spark, path, rows.drop("cod_distrito").schema)
    scaler = INC.standardise_incremental(stream, wanted, scratch_path(spark, "scaler-state"), scratch_path(spark, "scaler-stream"))
    state, check = scratch_path(spark, "kmeans-state"), scratch_path(spark, "kmeans-stream")
    centres = INC.minibatch_kmeans(stream, wanted, INC.scales_of(scaler, wanted), CENTROIDS, state, check)
    return rounded(centres.select("cluster", "weight", F.posexplode("centre").alias("dim", "centre")))


@register
def silhouette_by_k(spark, sf):
    """Silhouettes of fixed centres, for three numbers of clusters."""
    wanted = S.CLUSTER_FEATURES["B"]
    scaled = E.standardise(complete_connections(spark, sf, wanted), wanted)
    return rounded(K.silhouette_by_k(scaled, [f"z_{f}" for f in wanted], FIXED_CENTRES))


def labelled_connections(spark, sf) -> DataFrame:
    wanted = S.CLUSTER_FEATURES["B"]
    return K.assign_clusters(E.standardise(complete_connections(spark, sf, wanted), wanted), [f"z_{f}" for f in wanted], CENTROIDS)


@register
def assign_clusters(spark, sf):
    return labelled_connections(spark, sf).select("codcon", "cluster")


@register
def cluster_profiles(spark, sf):
    return rounded(K.cluster_profiles(labelled_connections(spark, sf), S.CLUSTER_FEATURES["B"]))


@register
def silhouette(spark, sf):
    """Squared-distance silhouette over all rows; the Euclidean one has a sample of stated size."""
    labelled = labelled_connections(spark, sf)
    z = [f"z_{f}" for f in S.CLUSTER_FEATURES["B"]]
    vectors = K.VectorAssembler(inputCols=z, outputCol="zvec").transform(labelled).persist()
    squared = K.silhouette(vectors)
    n = vectors.count()
    vectors.unpersist()
    out = spark.range(1).select(F.lit(squared).alias("silhouette_sq"), F.lit(n).cast("long").alias("n"))
    return rounded(out)


@register
def isolation_forest_fit(spark, sf):
    return rounded(
        IF.isolation_forest_fit(units(spark, sf), S.ANOMALY_FEATURES["A"], S.UNIT_KEYS)
    )


@register
def isolation_forest_score(spark, sf):
    flagged = IF.detect_anomalies(units(spark, sf), S.ANOMALY_FEATURES["A"], S.UNIT_KEYS)
    return rounded(flagged.select(*S.UNIT_KEYS, "score", "anomaly_score", "es_anomalia"))


#: Two small trees, written down: node, feature, threshold, children, depth, rows.
NODES = [
    (0, 0, 0, 20.0, 1, 2, 0, 64), (0, 1, -1, 0.0, -1, -1, 1, 24), (0, 2, 2, 40.0, 3, 4, 1, 40), (0, 3, -1, 0.0, -1, -1, 2, 39),
    (0, 4, -1, 0.0, -1, -1, 2, 1), (1, 0, 4, 0.5, 1, 2, 0, 64), (1, 1, -1, 0.0, -1, -1, 1, 50), (1, 2, -1, 0.0, -1, -1, 1, 14),
]


@register
def isolation_forest_fixed(spark, sf):
    """Scores of every unit by trees that are written down."""
    nodes = spark.createDataFrame(NODES, IF.NODE_SCHEMA)
    scored = IF.isolation_forest_score(units(spark, sf), S.ANOMALY_FEATURES["A"], nodes)
    return rounded(scored.select(*S.UNIT_KEYS, "score"))


@register
def isolation_forest_shape(spark, sf):
    rows = stored(spark, units(spark, sf).select(*S.UNIT_KEYS, *S.ANOMALY_FEATURES["A"]), "units")
    return IF.forest_shape(stored(spark, IF.isolation_forest_fit(rows, S.ANOMALY_FEATURES["A"], S.UNIT_KEYS), "forest"))


def one_dimension(spark, sf) -> DataFrame:
    """Connections by one scaled feature, where the best two clusters are a cut."""
    return K.scaled_vectors(complete_connections(spark, sf, ["num_unidades_uso"]), ["num_unidades_uso"])


@register
def kmeans_1d(spark, sf):
    vectors = stored_for_passes(one_dimension(spark, sf), "one-dimension", ["codcon"]).persist()
    try:
        labelled = K.kmeans(vectors, 2, tol=0.0).transform(vectors)
        return rounded(spark.createDataFrame(
            [(r["n"], r["pct"], r["num_unidades_uso"]) for r in K.cluster_profiles(labelled, ["num_unidades_uso"]).collect()],
            "n long, pct double, num_unidades_uso double",
        ))
    finally:
        vectors.unpersist()


@register
def best_k_search_1d(spark, sf):
    return rounded(K.best_k_search(one_dimension(spark, sf), ["codcon"], 2, 2, tol=0.0))


def stump(spark, sf, sampled: bool) -> B.Boosted:
    """One split of the district-months by one category or one number."""
    rows = districts(spark, sf).select(*S.FEATURE_TABLE_KEYS["C"], S.TARGET, "nomdis", "mes_absoluto")
    if sampled:
        return B.boosted_trees_sampled(rows, "C", maxIter=1, maxDepth=1, stepSize=1.0, subsamplingRate=1.0, featureSubsetStrategy="all")
    return B.boosted_trees(rows, "C", maxIter=1, maxDepth=1, stepSize=1.0)


@register
def boosted_stump(spark, sf):
    return rounded(stump(spark, sf, False).predictions)


@register
def boosted_stump_categories(spark, sf):
    """The same split with districts as categories, which may fall on either side."""
    return rounded(stump(spark, sf, True).predictions)


@register
def boosted_stump_importance(spark, sf):
    fit = stump(spark, sf, False)
    ranked = B.importance_rank(B.feature_importance(fit, spark)).join(B.split_counts(fit, spark), "feature")
    return rounded(ranked)


@register
def boosted_stump_metrics(spark, sf):
    return rounded(B.regression_metrics(stump(spark, sf, False).predictions))


@register
def out_of_fold_stump(spark, sf):
    """Two folds: each half is predicted by the split of the other one."""
    rows = districts(spark, sf).select(*S.FEATURE_TABLE_KEYS["C"], S.TARGET, "nomdis", "mes_absoluto")
    predicted = B.out_of_fold(stored(spark, rows, "districts"), "C", 2, maxIter=1, maxDepth=1, stepSize=1.0)
    alerts = I.deviation_alerts(predicted, S.TARGET, "prediction")
    return rounded(alerts)


# ---- causal ----


@register
def pretrend_means(spark, sf):
    return rounded(P.pretrend_means(P.did_panel(consumo(spark, sf), allow_short=True)))


@register
def pretrend_gap(spark, sf):
    return rounded(P.pretrend_gap(P.did_panel(consumo(spark, sf), allow_short=True)))


@register
def event_times(spark, sf):
    return P.event_times(P.event_study_panel(consumo(spark, sf)))


@register
def dummy_encode(spark, sf):
    fact = consumo(spark, sf)
    coded = G.dummy_encode(fact, ["codcat", "codmof"])
    names = [c for c in coded.columns if c not in fact.columns]
    return rounded(coded.groupBy("codcat", "codmof").agg(*[F.sum(c).alias(c) for c in names]))


@register
def design_matrix(spark, sf):
    fact = consumo(spark, sf)
    terms = [
        G.intercept(), G.numeric(M.month_index("nuanio", "nummes"), "mes_abs"), G.numeric("hoxdia", "hoxdia"),
        G.indicator("codcat", "102"), G.indicator("codcat", "103"),
    ]
    return rounded(G.design_matrix(fact, terms, ["codcon", "codudu"]))


@register
def product_matrix(spark, sf):
    fact = consumo(spark, sf)
    entries = G.product_matrix(fact, [F.lit(1.0), F.col("hoxdia"), F.col("diasem"), F.col("volfac")])
    return rounded(entries, 2)


def narrow_consumo(spark, sf, *columns: str) -> DataFrame:
    """Some columns of the billing records, stored: a regression scans its rows three times or more."""
    return stored(spark, consumo(spark, sf).select(*G.CLUSTER, "volfac", *columns), "fact")


def category_terms(fact: DataFrame) -> list[G.Term]:
    return [G.intercept(), *G.dummy_terms(["codcat"], G.design_statistics(fact, ["codcat"], []).levels)]


@register
def ols_normal_equations(spark, sf):
    fact = narrow_consumo(spark, sf, "codcat")
    return rounded(G.ols(fact, "volfac", category_terms(fact), None).select("term", "coef", "n_obs", "rank"))


@register
def ols_fit_stats(spark, sf):
    fact = narrow_consumo(spark, sf, "codcat")
    fit = G.cluster_robust(fact, G.ols_normal_equations(fact, "volfac", category_terms(fact)))
    return rounded(spark.createDataFrame([(fit.n, fit.sse, fit.sst, fit.r2)], "n long, sse double, sst double, r2 double"), 4)


@register
def cluster_scores(spark, sf):
    fact = narrow_consumo(spark, sf, "codcat")
    fit = G.ols_normal_equations(fact, "volfac", category_terms(fact))
    return rounded(G.cluster_scores(fact, fit), 4)


@register
def cluster_robust_se(spark, sf):
    fact = narrow_consumo(spark, sf, "codcat")
    return rounded(G.ols(fact, "volfac", category_terms(fact)).select("term", "coef", "std_error", "t_stat", "n_clusters"))


@register
def event_study(spark, sf):
    panel = event_study_panel(spark, sf)
    plain = G.event_study(panel, categorical=(), numerics=(), trend=False)
    return rounded(plain.select("event_type", "baseline", "term", "coef", "std_error", "n_obs", "n_clusters", "r2"))


@register
def event_study_covariates(spark, sf):
    return rounded(G.coef_interval(G.event_study(event_study_panel(spark, sf))))


@register
def coef_interval(spark, sf):
    fact = narrow_consumo(spark, sf, "codcat")
    return rounded(G.coef_interval(G.ols(fact, "volfac", category_terms(fact))).select("term", "ci_low", "ci_high"))


@register
def did_basic(spark, sf):
    return rounded(P.did_basic(P.did_panel(consumo(spark, sf), allow_short=True)))


@register
def did_ols_saturated(spark, sf):
    panel = did_panel(spark, sf)
    plain = G.did_ols_cluster(panel, categorical=(), numerics=())
    return rounded(plain.select("term", "coef", "std_error", "n_obs", "n_clusters", "r2"))


@register
def did_result_document(spark, sf):
    """The result document of the regression without covariates, stored and read back."""
    path = scratch_path(spark, "did-document")
    plain = G.did_ols_cluster(did_panel(spark, sf), categorical=(), numerics=())
    sinks.result_json_sink(results.did_document(plain, (), ()), path)
    doc = spark.read.json(path)
    places = F.explode(F.arrays_zip("coef_names", "coef", "std_error", "t_stat"))
    sizes = [F.size(f"covariables.{c}").alias(f"n_{c}") for c in ("categoricas", "numericas")]
    rows = doc.select("modelo", "n_obs", "n_clusters", "r2", *sizes, places.alias("e")).select("*", "e.*").drop("e")
    return rounded(rows)


@register
def did_ols_cluster(spark, sf):
    return rounded(G.did_ols_cluster(did_panel(spark, sf)))


# ---- impact ----


@register
def excess_loss(spark, sf):
    comparison = IF.anomaly_comparison(scored_units(spark, sf), S.ANOMALY_FEATURES["A"])
    return rounded(I.excess_loss(comparison, TARIFF), 4)


@register
def policy_impact(spark, sf):
    fact = consumo(spark, sf)
    n = P.first_transition(fact, "1to2").count()
    effects = P.did_basic(P.did_panel(fact, allow_short=True)).select(F.lit(n).cast("long").alias("n_units"), "effect")
    return rounded(I.policy_impact(effects, TARIFF, effect="effect"), 4)


@register
def deviation_alerts(spark, sf):
    d = demand(spark, sf)
    expected = d.groupBy("coddis", "nummes").agg(F.avg("demanda_total_m3").alias("esperado"))
    return rounded(
        I.deviation_alerts(d.join(expected, ["coddis", "nummes"]), "demanda_total_m3", "esperado").select(
            "coddis", "nuanio", "nummes", "demanda_total_m3", "esperado", "desviacion"
        )
    )


@register
def sample_rows_text_keys(spark, sf):
    """Orders drawn by a key that is no number."""
    keyed = table(spark, sf, "orders").select(F.concat(F.lit("k"), F.col("o_orderkey").cast("string")).alias("key"))
    return billing.sample_rows(keyed, TEXT_SAMPLE, ["key"])


@register
def quantiles_null_groups(spark, sf):
    """Exact quartiles where some groups hold nulls only, by the way of hot groups."""
    value = F.when(F.col("l_suppkey") % 10 != 0, F.col("l_quantity").cast("double"))
    rows = table(spark, sf, "lineitem").select("l_suppkey", value.alias("v"))
    return rounded(Q.group_quantiles(rows, ["l_suppkey"], "v", {"q25": 0.25, "q50": 0.5, "q75": 0.75}, hot_rows=1))


@register
def sample_controls_ratio2(spark, sf):
    """Two controls for each unit that lost the subsidy in one year, so that the ratio binds."""
    history = stored(spark, P.unit_history(consumo(spark, sf)), "unit-history")
    of_year = P.events_of(history, "1to2").filter(F.col("mes_evento").between(EVENT_YEAR * 12 + 1, EVENT_YEAR * 12 + 12))
    return P.sample_controls(of_year, history.filter("nunca"), ratio=2)


@register
def did_basic_t(spark, sf):
    return rounded(G.did_basic_t(did_panel(spark, sf)))


@register
def ols_covariate_fwl(spark, sf):
    """One number and one category, clustered by unit: the number's coefficient."""
    rows = narrow_consumo(spark, sf, "codcat", "imagua")
    terms, _, cells = G.covariate_terms(rows, ["codcat"], ["imagua"], False)
    found = G.ols(rows, "volfac", [G.intercept(), *terms], G.CLUSTER, cells)
    return rounded(found.filter("term = 'imagua'").select("term", "coef", "std_error", "n_obs", "n_clusters"))
