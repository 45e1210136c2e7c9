"""Time series operators over many series at once.

Input: one row per series and period, ``serie, nuanio, nummes, valor``. A
series has at most one row per calendar month, so its window is short however
many billing records stand behind it; series are spread over executors.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


PERIOD = 12
MIN_POINTS = 12
TOTAL_NAME = "TOTAL (todos los distritos)"

# MacKinnon (1994) response surface of the Dickey-Fuller tau
# statistic, one series, regression with a constant.
TAU_MAX = 2.74
TAU_MIN = -18.83
TAU_STAR = -1.61
TAU_SMALL_P = (2.1659, 1.4412, 0.038269)
TAU_LARGE_P = (1.7339, 0.93202, -0.12745, -0.010368)


def district_series(districts: DataFrame) -> DataFrame:
    return districts.groupBy(F.col("nomdis").alias("serie"), "nuanio", "nummes").agg(
        F.sum("demanda_total_m3").alias("valor")
    )


def total_as_series(districts: DataFrame, name: str = TOTAL_NAME) -> DataFrame:
    return (
        districts.groupBy("nuanio", "nummes")
        .agg(F.sum("demanda_total_m3").alias("valor"))
        .select(F.lit(name).alias("serie"), "nuanio", "nummes", "valor")
    )


def complete_months(series: DataFrame, fill: float = 0.0) -> DataFrame:
    """Insert the missing months between a series' first and last one."""
    month = (F.col("nuanio") * 12 + F.col("nummes") - 1).cast("int")
    indexed = series.withColumn("_m", month)
    span = indexed.groupBy("serie").agg(F.explode(F.sequence(F.min("_m"), F.max("_m"))).alias("_m"))
    return span.join(indexed.select("serie", "_m", "valor"), ["serie", "_m"], "left").select(
        "serie",
        F.floor(F.col("_m") / 12).cast("int").alias("nuanio"),
        (F.col("_m") % 12 + 1).cast("int").alias("nummes"),
        F.coalesce("valor", F.lit(fill)).alias("valor"),
    )


def series_select(
    series: DataFrame, name: str | None = None, top: int = 5, min_points: int = MIN_POINTS
) -> DataFrame:
    """One named series, or the ``top`` by total; series under ``min_points`` are left out."""
    totals = series.groupBy("serie").agg(F.sum("valor").alias("_total"), F.count("valor").alias("_n"))
    if name is not None:
        chosen = totals.filter(F.col("serie") == name)
    else:
        chosen = totals.orderBy(F.desc("_total"), "serie").limit(top)
    return series.join(chosen.filter(F.col("_n") >= min_points).select("serie"), "serie", "left_semi")


def series_stats(series: DataFrame) -> DataFrame:
    return series.groupBy("serie").agg(
        F.count("valor").alias("n_puntos"),
        F.avg("valor").alias("media"),
        F.stddev_pop("valor").alias("std"),
        F.min("valor").alias("min"),
        F.max("valor").alias("max"),
    )


def centred_moving_average(series: DataFrame, period: int = PERIOD) -> DataFrame:
    """2 x period centred mean; null for half a period at each end."""
    half = period // 2
    in_time = Window.partitionBy("serie").orderBy("nuanio", "nummes")
    whole = Window.partitionBy("serie")
    inner = F.sum("valor").over(in_time.rowsBetween(-(half - 1), half - 1))
    ends = F.lag("valor", half).over(in_time) + F.lead("valor", half).over(in_time)
    return series.select(
        "*",
        (F.row_number().over(in_time) - 1).alias("t"),
        F.count(F.lit(1)).over(whole).alias("n_puntos"),
        ((inner + 0.5 * ends) / float(period)).alias("tendencia"),
    )


def _decompose(series: DataFrame, period: int) -> DataFrame:
    """Decomposition columns for every series; null where a series is too short.

    All windows share the partitioning by series, so there is one exchange.
    """
    smooth = centred_moving_average(series, period)
    long_enough = F.col("n_puntos") >= 2 * period
    by_position = Window.partitionBy("serie", "_p")
    whole = Window.partitionBy("serie")
    raw = F.avg(F.col("valor") - F.col("tendencia")).over(by_position)
    # the first period holds each position once
    centre = F.avg(F.when(F.col("t") < period, F.col("_raw"))).over(whole)
    return (
        smooth.withColumn("tendencia", F.when(long_enough, F.col("tendencia")))
        .withColumn("_p", F.col("t") % period)
        .withColumn("_raw", raw)
        .withColumn("estacional", F.when(long_enough, F.col("_raw") - centre))
        .withColumn("residuo", F.col("valor") - F.col("tendencia") - F.col("estacional"))
        .withColumn("posicion", F.col("_p") + 1)
        .drop("_p", "_raw")
    )


def seasonal_decompose(series: DataFrame, period: int = PERIOD) -> DataFrame:
    """Additive decomposition of every series with at least two periods."""
    return _decompose(series, period).filter(F.col("n_puntos") >= 2 * period)


def seasonal_component(series: DataFrame, period: int = PERIOD) -> DataFrame:
    return seasonal_decompose(series, period).select("serie", "nuanio", "nummes", "t", "estacional")


def trend_change(decomposed: DataFrame) -> DataFrame:
    """First and last trend value and the change in percent."""
    known = F.when(F.col("tendencia").isNotNull(), F.col("t"))
    ends = decomposed.groupBy("serie").agg(
        F.min_by("tendencia", known).alias("tendencia_inicio"),
        F.max_by("tendencia", known).alias("tendencia_fin"),
    )
    change = (F.try_divide(F.col("tendencia_fin"), F.col("tendencia_inicio")) - 1) * 100
    return ends.withColumn("tendencia_cambio_pct", change)


def seasonal_amplitude(decomposed: DataFrame) -> DataFrame:
    return (
        decomposed.groupBy("serie")
        .agg(
            F.max("estacional").alias("estacionalidad_max"),
            F.min("estacional").alias("estacionalidad_min"),
        )
        .withColumn("estacionalidad_amplitud", F.col("estacionalidad_max") - F.col("estacionalidad_min"))
    )


def monthly_pattern(decomposed: DataFrame) -> DataFrame:
    """Seasonal value per position from the series start, with its calendar month."""
    return decomposed.groupBy("serie", "posicion").agg(
        F.min_by("nummes", "t").alias("mes"), F.avg("estacional").alias("patron")
    )


def peak_trough_month(pattern: DataFrame, month: str = "posicion") -> DataFrame:
    """Months of the largest and smallest seasonal value; the first on ties."""
    best = F.max(F.struct(F.col("patron").alias("v"), (-F.col(month)).alias("m")))
    worst = F.min(F.struct(F.col("patron").alias("v"), F.col(month).alias("m")))
    return (
        pattern.groupBy("serie")
        .agg(best.alias("_b"), worst.alias("_w"))
        .select(
            "serie",
            (-F.col("_b.m")).alias("mes_max"),
            F.col("_b.v").alias("valor_max"),
            F.col("_w.m").alias("mes_min"),
            F.col("_w.v").alias("valor_min"),
        )
    )


def mackinnon_p(tau: float) -> float:
    if tau > TAU_MAX:
        return 1.0
    if tau < TAU_MIN:
        return 0.0
    coef = TAU_SMALL_P if tau <= TAU_STAR else TAU_LARGE_P
    z = sum(c * tau**i for i, c in enumerate(coef))
    return 0.5 * math.erfc(-z / math.sqrt(2.0))


def _adf_regression(y: np.ndarray, lag: int, skip: int) -> tuple[float, float]:
    """tau and AIC of dy ~ 1 + y(-1) + dy(-1..-lag), leaving out ``skip`` first differences."""
    dy = np.diff(y)
    target = dy[skip:]
    columns = [np.ones(len(target)), y[skip:-1]]
    columns += [dy[skip - j : len(dy) - j] for j in range(1, lag + 1)]
    x = np.column_stack(columns)
    beta, _, _, _ = np.linalg.lstsq(x, target, rcond=None)
    resid = target - x @ beta
    n, k = x.shape
    sse = float(resid @ resid)
    var = sse / (n - k) * np.linalg.pinv(x.T @ x)[1, 1]
    aic = n * (math.log(2 * math.pi * sse / n) + 1) + 2 * k
    return float(beta[1] / math.sqrt(var)), aic


def _adf_of(values: np.ndarray) -> tuple[float | None, int | None]:
    y = np.asarray(values, dtype=float)
    n = len(y)
    top = min(math.ceil(12.0 * (n / 100.0) ** 0.25), n // 2 - 2)
    if top < 0 or np.ptp(y) == 0:
        return None, None
    try:
        scores = [(_adf_regression(y, lag, top)[1], lag) for lag in range(top + 1)]
        lag = min(scores)[1]
        return _adf_regression(y, lag, lag)[0], lag
    except (np.linalg.LinAlgError, ValueError, ZeroDivisionError):
        return None, None


def adf_test(series: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Augmented Dickey-Fuller test with a constant; the lag minimises AIC."""

    def test(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        tau, lag = _adf_of(pdf.sort_values(["nuanio", "nummes"])["valor"].to_numpy())
        p = None if tau is None else mackinnon_p(tau)
        return pd.DataFrame(
            {
                "serie": [key[0]],
                "adf_statistic": [tau],
                "adf_pvalue": [p],
                "adf_lag": pd.array([lag], dtype="Int32"),
                "es_estacionaria": pd.array([None if p is None else p < alpha], dtype="boolean"),
            }
        )

    return series.groupBy("serie").applyInPandas(
        test,
        "serie string, adf_statistic double, adf_pvalue double, adf_lag int, es_estacionaria boolean",
    )


def dickey_fuller(series: DataFrame) -> DataFrame:
    """Dickey-Fuller statistic without lags, from window and regression aggregates alone."""
    in_time = Window.partitionBy("serie").orderBy("nuanio", "nummes")
    pairs = series.withColumn("_x", F.lag("valor").over(in_time)).filter(F.col("_x").isNotNull())
    d = F.col("valor") - F.col("_x")
    sums = pairs.groupBy("serie").agg(
        F.count(F.lit(1)).alias("n"),
        F.regr_slope(d, F.col("_x")).alias("b"),
        F.regr_sxx(d, F.col("_x")).alias("sxx"),
        F.regr_syy(d, F.col("_x")).alias("syy"),
        F.regr_sxy(d, F.col("_x")).alias("sxy"),
    )
    sse = F.col("syy") - F.col("b") * F.col("sxy")
    se = F.sqrt(F.try_divide(sse, (F.col("n") - 2) * F.col("sxx")))
    return sums.select("serie", "n", F.try_divide(F.col("b"), se).alias("df_statistic"))


def adf_fixed_lag(series: DataFrame) -> DataFrame:
    """Augmented Dickey-Fuller statistic with a constant and one lagged difference, without Python.

    Least squares on two regressors in closed form: the coefficient of the lagged
    level from centred sums, after the lagged difference is partialled out. Null
    where a series is too short or the two regressors are collinear.
    """
    in_time = Window.partitionBy("serie").orderBy("nuanio", "nummes")
    rows = series.select("serie", "nuanio", "nummes", "valor", F.lag("valor").over(in_time).alias("_x"), F.lag("valor", 2).over(in_time).alias("_w"))
    y, x, z = F.col("valor") - F.col("_x"), F.col("_x"), F.col("_x") - F.col("_w")
    rows = rows.filter(F.col("_w").isNotNull()).select("serie", y.alias("y"), x.alias("x"), z.alias("z"))
    n = F.count(F.lit(1))
    sums = rows.groupBy("serie").agg(
        n.alias("n"),
        *[(F.covar_pop(a, b) * n).alias(a + b) for a, b in ("xx", "zz", "yy", "xz", "xy", "zy")],
    )
    det = F.col("xx") * F.col("zz") - F.col("xz") * F.col("xz")
    b = F.try_divide(F.col("xy") * F.col("zz") - F.col("zy") * F.col("xz"), det)
    g = F.try_divide(F.col("zy") * F.col("xx") - F.col("xy") * F.col("xz"), det)
    sse = F.col("yy") - b * F.col("xy") - g * F.col("zy")
    se = F.sqrt(F.try_divide(sse, F.col("n") - 3) * F.try_divide(F.col("zz"), det))
    return sums.select("serie", "n", F.when(F.col("n") > 3, F.try_divide(b, se)).alias("adf_statistic"))


def seasonal_summary(series: DataFrame, with_test: bool = True, period: int = PERIOD) -> DataFrame:
    """One row per series: level, spread, trend, seasonality, peak and trough.

    Every figure comes from one aggregation of the decomposed rows.
    """
    known = F.when(F.col("tendencia").isNotNull(), F.col("t"))
    seasonal = F.col("estacional")
    peak = F.max(F.when(seasonal.isNotNull(), F.struct(seasonal.alias("v"), (-F.col("posicion")).alias("m"))))
    trough = F.min(F.when(seasonal.isNotNull(), F.struct(seasonal.alias("v"), F.col("posicion").alias("m"))))
    out = (
        _decompose(series, period)
        .groupBy("serie")
        .agg(
            F.count("valor").alias("n_puntos"),
            F.avg("valor").alias("media"),
            F.stddev_pop("valor").alias("std"),
            F.min("valor").alias("min"),
            F.max("valor").alias("max"),
            F.min_by("tendencia", known).alias("tendencia_inicio"),
            F.max_by("tendencia", known).alias("tendencia_fin"),
            F.max(seasonal).alias("estacionalidad_max"),
            F.min(seasonal).alias("estacionalidad_min"),
            peak.alias("_b"),
            trough.alias("_w"),
        )
        .select(
            "serie", "n_puntos", "media", "std", "min", "max", "tendencia_inicio", "tendencia_fin",
            ((F.try_divide(F.col("tendencia_fin"), F.col("tendencia_inicio")) - 1) * 100).alias(
                "tendencia_cambio_pct"
            ),
            "estacionalidad_max",
            "estacionalidad_min",
            (F.col("estacionalidad_max") - F.col("estacionalidad_min")).alias("estacionalidad_amplitud"),
            (-F.col("_b.m")).alias("mes_max"),
            F.col("_b.v").alias("valor_max"),
            F.col("_w.m").alias("mes_min"),
            F.col("_w.v").alias("valor_min"),
        )
    )
    return out.join(adf_test(series), "serie", "left") if with_test else out


def series_document(series: DataFrame) -> DataFrame:
    """The nested result entry of each series, pattern as a month map."""
    pattern = (
        monthly_pattern(seasonal_decompose(series))
        .groupBy("serie")
        .agg(
            F.map_from_entries(
                F.array_sort(F.collect_list(F.struct(F.col("posicion").cast("string"), "patron")))
            ).alias("patron_mensual")
        )
    )
    return (
        seasonal_summary(series)
        .drop("mes_max", "valor_max", "mes_min", "valor_min", "adf_lag")
        .withColumn("es_estacionaria", F.initcap(F.col("es_estacionaria").cast("string")))
        .join(pattern, "serie", "left")
        .withColumnRenamed("serie", "nombre")
    )


def districts_and_total(districts: DataFrame) -> DataFrame:
    return total_as_series(districts).unionByName(district_series(districts))


