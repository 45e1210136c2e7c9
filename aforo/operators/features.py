"""The three feature tables: unit, connection and district-month."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from aforo import schema as S
from aforo.functions import measures as M
from aforo.operators import aggregates as A
from aforo.operators.quantiles import HOT_ROWS, group_quantiles
from aforo.session import stored

#: Rows of which one task collects distinct ids.
ROWS_PER_DISTINCT = 500_000
TIME_ORDER = ["nuanio", "nummes"]


def _billing(guard: str) -> list[Column]:
    return [
        F.sum(M.bill_total()).alias("importe_total"),
        # per-record tariff, then averaged: not the ratio of the sums
        F.avg(M.safe_ratio("importe_agua", "consumo", guard)).alias("tarifa_efectiva"),
    ]


def _seasonal() -> list[Column]:
    estacion = M.season("nummes")
    return [
        A.conditional_mean("consumo", estacion == S.SUMMER).alias("consumo_verano"),
        A.conditional_mean("consumo", estacion == S.WINTER).alias("consumo_invierno"),
    ]


def _read_twice(rows: DataFrame, hot_rows: int | None) -> DataFrame:
    """Rows for ``group_quantiles``: stored where it looks for hot groups first."""
    return rows if hot_rows is None else stored(rows, "records")


def _dealt(rows: DataFrame, keys: list[str], hot_rows: int | None) -> DataFrame:
    """Stored rows, some ``ROWS_PER_DISTINCT`` a task, so that what a task's distinct holds does not grow.

    They are dealt by all their columns: rows of one id differ in others, so a hot id goes to many tasks.
    """
    if hot_rows is None:
        return rows
    tasks = max(1, math.ceil(rows.count() / ROWS_PER_DISTINCT))
    share = F.pmod(F.xxhash64(*rows.columns), F.lit(16 * tasks)).cast("int")
    return rows.withColumn("_share", share).select(*keys, "_share").repartition(tasks, "_share")


def features_unit(df: DataFrame, guard: str = "positive", hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """One row per (unit, connection): consumption profile, billing, service, season.

    One exchange on the key. The median is exact; see ``quantiles`` for units
    that hold very many records. The search for those reads the records
    too, so what makes them runs once and their columns are stored.
    """
    attributes = ["nomdis", "coddis", "nomcat", "codcat", "situdu", "coorpx", "coorpy"]
    aggs = [
        A.representative(TIME_ORDER, attributes).alias("_first"),
        *A.moments("consumo", "consumo"),
        *_billing(guard),
        F.avg("horas_dia").alias("horas_dia_prom"),
        F.avg("dias_semana").alias("dias_semana_prom"),
        F.avg(M.service_quality()).alias("score_calidad"),
        A.record_count(),
        *_seasonal(),
    ]
    columns = [*S.UNIT_KEYS, *TIME_ORDER, *attributes, *M.MEASURES.values()]
    grouped = group_quantiles(
        _read_twice(M.cast_measures(df).select(*dict.fromkeys(columns)), hot_rows),
        S.UNIT_KEYS,
        "consumo",
        {"consumo_mediana": 0.5},
        aggs,
        hot_rows=hot_rows,
        small_groups=True,
        distinct={"anios_activos": "nuanio"},
    )
    return grouped.select(
        *S.UNIT_KEYS,
        F.col("_first.nomdis").alias("distrito"),
        F.col("_first.coddis").alias("cod_distrito"),
        F.col("_first.nomcat").alias("categoria"),
        F.col("_first.codcat").alias("cod_categoria"),
        F.col("_first.situdu").alias("situdu"),
        F.col("_first.coorpx").alias("coord_x"),
        F.col("_first.coorpy").alias("coord_y"),
        "consumo_promedio", "consumo_std", "consumo_min", "consumo_max", "consumo_total",
        "consumo_mediana", "importe_total", "tarifa_efectiva", "horas_dia_prom",
        "dias_semana_prom", "score_calidad", "registros_totales", "anios_activos",
        "consumo_verano", "consumo_invierno",
        M.spread("consumo_max", "consumo_min").alias("consumo_rango"),
        M.safe_ratio("consumo_std", "consumo_promedio", guard).alias("coef_variacion"),
        M.spread("consumo_verano", "consumo_invierno").alias("delta_estacional"),
        M.subsidy_flag(F.col("_first.situdu")).alias("es_subsidiado"),
    )


def features_connection(df: DataFrame, guard: str = "positive") -> DataFrame:
    """One row per connection: size, subsidy share and consumption profile.

    The unit count is the only unbounded distinct count. Inside the wide
    aggregation it would carry every buffer through a shuffle by (connection,
    unit), so it runs on its two columns and joins by connection; years and
    categories are bounded sets.
    """
    attributes = ["nomdis", "coddis", "nomcat", "codcat", "coorpx", "coorpy"]
    grouped = (
        M.cast_measures(df)
        .groupBy(*S.CONNECTION_KEYS)
        .agg(
            A.representative(TIME_ORDER, attributes).alias("_first"),
            *A.moments("consumo", "consumo"),
            *_billing(guard),
            F.avg("horas_dia").alias("horas_dia_prom"),
            F.avg(M.service_quality()).alias("score_calidad"),
            A.record_count(),
            A.small_distinct("nuanio").alias("anios_activos"),
            A.conditional_count(F.col("situdu") == S.SUBSIDISED).alias("registros_subsidiados"),
            *_seasonal(),
            A.small_distinct("codcat").alias("num_categorias"),
        )
    )
    units = A.distinct_counts(df, S.CONNECTION_KEYS, {"codudu": "num_unidades_uso"})
    right = units.select(F.col("codcon").alias("_codcon"), "num_unidades_uso")
    return grouped.join(right, F.col("codcon").eqNullSafe(F.col("_codcon"))).select(
        *S.CONNECTION_KEYS,
        F.col("_first.nomdis").alias("distrito"),
        F.col("_first.coddis").alias("cod_distrito"),
        F.col("_first.nomcat").alias("categoria_principal"),
        F.col("_first.codcat").alias("cod_categoria"),
        F.col("_first.coorpx").alias("coord_x"),
        F.col("_first.coorpy").alias("coord_y"),
        "num_unidades_uso", "consumo_promedio", "consumo_std", "consumo_min", "consumo_max",
        "consumo_total", "importe_total", "tarifa_efectiva", "horas_dia_prom", "score_calidad",
        "registros_totales", "anios_activos", "registros_subsidiados", "consumo_verano",
        "consumo_invierno", "num_categorias",
        M.spread("consumo_max", "consumo_min").alias("consumo_rango"),
        M.safe_ratio("consumo_std", "consumo_promedio", guard).alias("coef_variacion"),
        M.spread("consumo_verano", "consumo_invierno").alias("delta_estacional"),
        M.share("registros_subsidiados", "registros_totales").alias("pct_subsidiado"),
        F.try_divide(F.col("consumo_total"), F.col("num_unidades_uso")).alias("consumo_por_udu"),
        M.size_bucket("num_unidades_uso").alias("tipo_predio"),
    )


def features_district_month(
    df: DataFrame,
    guard: str = "positive",
    base_year: int = S.BASE_YEAR,
    quantile_method: str = "linear",
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """One row per district and month, in order: demand, billing, quantiles, mix.

    The records are read three times or more, so their columns are stored.
    """
    keys = S.DISTRICT_MONTH_KEYS
    numbers = all(isinstance(df.schema[c].dataType, IntegralType) for c in S.UNIT_KEYS)
    columns = [*keys, *TIME_ORDER, *S.UNIT_KEYS, "codcat", "situdu", *M.MEASURES.values()]
    df = base = _read_twice(M.cast_measures(df).select(*dict.fromkeys(columns)), hot_rows)
    aggs = [
        A.record_count("num_registros"),
        F.sum("consumo").alias("demanda_total_m3"),
        F.sum(M.bill_total()).alias("facturacion_total"),
        F.avg("consumo").alias("consumo_promedio"),
        F.stddev_samp("consumo").alias("consumo_std"),
        F.avg(M.service_quality()).alias("score_calidad"),
        A.conditional_count(F.col("codcat") == S.CATEGORY_DOMESTIC).alias("n_domestico"),
        A.conditional_count(F.col("codcat") == S.CATEGORY_COMMERCIAL).alias("n_comercial"),
        A.conditional_count(F.col("codcat") == S.CATEGORY_INDUSTRIAL).alias("n_industrial"),
        A.conditional_count(F.col("situdu") == S.SUBSIDISED).alias("n_subsidiados"),
    ]
    probs = {"consumo_mediana": 0.5, "consumo_p25": 0.25, "consumo_p75": 0.75, "consumo_p95": 0.95}
    main = group_quantiles(base, keys, "consumo", probs, aggs, method=quantile_method, hot_rows=hot_rows)
    # Two distinct counts would send every wide row through the shuffle three
    # times; here only (group, kind, id) is shuffled, and the join is on groups.
    id_type = "long" if numbers else "string"
    ids = F.array(
        F.struct(F.lit(0).alias("kind"), F.col("codudu").cast(id_type).alias("id")),
        F.struct(F.lit(1).alias("kind"), F.col("codcon").cast(id_type).alias("id")),
    )
    right = (
        _dealt(df, [*keys, *S.UNIT_KEYS], hot_rows)
        .select(*[F.col(k).alias(f"_{k}") for k in keys], F.explode(ids).alias("e"))
        .select(*[f"_{k}" for k in keys], "e.kind", "e.id")
        .filter(F.col("id").isNotNull())
        .distinct()
        .groupBy(*[f"_{k}" for k in keys])
        .agg(
            F.count_if(F.col("kind") == 0).alias("num_unidades"),
            F.count_if(F.col("kind") == 1).alias("num_conexiones"),
        )
    )
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return (
        main.join(right, on, "left")
        .select(
            *keys,
            M.month_index("nuanio", "nummes", base_year).alias("mes_absoluto"),
            M.season("nummes").alias("estacion"),
            "num_registros",
            F.coalesce("num_unidades", F.lit(0)).alias("num_unidades"),
            F.coalesce("num_conexiones", F.lit(0)).alias("num_conexiones"),
            "demanda_total_m3",
            "facturacion_total", "consumo_promedio", "consumo_std",
            *probs,
            "score_calidad", "n_domestico", "n_comercial", "n_industrial", "n_subsidiados",
            M.share_pct("n_domestico", "num_registros").alias("pct_domestico"),
            M.share_pct("n_comercial", "num_registros").alias("pct_comercial"),
            M.share_pct("n_industrial", "num_registros").alias("pct_industrial"),
            M.share_pct("n_subsidiados", "num_registros").alias("pct_subsidiado"),
            F.try_divide(F.col("demanda_total_m3"), F.col("num_unidades")).alias("consumo_per_unidad"),
            M.safe_ratio("facturacion_total", "demanda_total_m3", guard).alias("tarifa_promedio"),
            M.safe_ratio("consumo_std", "consumo_promedio", guard).alias("coef_variacion"),
            M.spread("consumo_p75", "consumo_p25").alias("iqr_consumo"),
        )
        .orderBy("coddis", "nuanio", "nummes")
    )


def district_demand(df: DataFrame, base_year: int = S.BASE_YEAR) -> DataFrame:
    """The demand column of the district-month table alone, for the series operators."""
    return (
        df.groupBy(*S.DISTRICT_MONTH_KEYS)
        .agg(F.sum(F.col("volfac").cast("double")).alias("demanda_total_m3"))
        .withColumn("mes_absoluto", M.month_index("nuanio", "nummes", base_year))
    )
