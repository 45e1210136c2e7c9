"""Reusable aggregates and small group reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aforo.functions.measures import col, safe_ratio


#: Levels of one column that may be listed in a row.
MOST_LEVELS = 100_000


def moments(value: Column | str, prefix: str) -> list[Column]:
    """Mean, sample deviation, minimum, maximum, sum and row count."""
    v = col(value)
    return [
        F.avg(v).alias(f"{prefix}_promedio"),
        F.stddev_samp(v).alias(f"{prefix}_std"),
        F.min(v).alias(f"{prefix}_min"),
        F.max(v).alias(f"{prefix}_max"),
        F.sum(v).alias(f"{prefix}_total"),
    ]


def record_count(name: str = "registros_totales") -> Column:
    return F.count(F.lit(1)).alias(name)


def coef_variation(df: DataFrame, keys: Sequence[str], value: str, guard: str = "positive") -> DataFrame:
    stats = df.groupBy(*keys).agg(F.avg(value).alias("media"), F.stddev_samp(value).alias("std"))
    return stats.withColumn("coef_variacion", safe_ratio("std", "media", guard))


def representative(order: Sequence[str], columns: Sequence[str]) -> Column:
    """The attributes of a group's earliest record as one struct.

    Ordering by time and then by the attributes themselves makes it
    deterministic, and it merges map-side, unlike a sorted ``first``.
    """
    return F.min(F.struct(*order, *columns))


def small_distinct(column: str) -> Column:
    """Exact distinct count of a low-cardinality column (years, categories).

    A set per group needs no extra shuffle or row expansion; use
    ``count_distinct`` where the number of values is not bounded.
    """
    return F.size(F.collect_set(column)).cast("long")


def distinct_counts(df: DataFrame, keys: Sequence[str], columns: dict[str, str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.count_distinct(c).alias(name) for c, name in columns.items()])


def approximate_distinct_counts(
    df: DataFrame, keys: Sequence[str], columns: dict[str, str], rsd: float = 0.05
) -> DataFrame:
    """Sketch variant: one pass, no expansion, relative deviation ``rsd``."""
    return df.groupBy(*keys).agg(
        *[F.approx_count_distinct(c, rsd).alias(name) for c, name in columns.items()]
    )


def conditional_mean(value: Column | str, condition: Column) -> Column:
    return F.avg(F.when(condition, col(value)))


def conditional_count(condition: Column) -> Column:
    return F.count_if(condition)


def size_distribution(connections: DataFrame, column: str = "tipo_predio") -> DataFrame:
    return (
        connections.groupBy(column)
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), column)
    )


def coverage_stats(districts: DataFrame) -> DataFrame:
    return districts.agg(
        F.count_distinct("coddis").alias("n_distritos"),
        F.count_distinct("mes_absoluto").alias("n_meses"),
    )


def top_districts(districts: DataFrame, n: int = 5) -> DataFrame:
    """Districts with the largest total demand; ties by name."""
    return (
        districts.groupBy("nomdis")
        .agg(F.sum("demanda_total_m3").alias("total_demanda"))
        .orderBy(F.desc("total_demanda"), "nomdis")
        .limit(n)
    )


def total_series(districts: DataFrame) -> DataFrame:
    """Demand summed over districts per month, in time order."""
    return (
        districts.groupBy("nuanio", "nummes")
        .agg(
            F.sum("demanda_total_m3").alias("demanda_total"),
            F.min("mes_absoluto").alias("mes_absoluto"),
        )
        .orderBy("nuanio", "nummes")
    )


def distinct_values(df: DataFrame, columns: Sequence[str], most: int = MOST_LEVELS) -> DataFrame:
    """Sorted non-null levels of low-cardinality columns, in one pass after a count by sketch.

    A column with clearly more than ``most`` levels is refused: its levels
    would all meet in one row.
    """
    if columns:
        sketch = df.agg(*[F.approx_count_distinct(c).alias(c) for c in columns]).first()
        if large := [c for c in columns if sketch[c] > 1.2 * most]:
            raise ValueError(f"more than {most} levels in {', '.join(large)}")
    return df.agg(*[F.array_sort(F.collect_set(c)).alias(c) for c in columns])


def pivot_mean(
    df: DataFrame, index: str, column: str, levels: Sequence, value: str, prefix: str = ""
) -> DataFrame:
    """Mean by index with one output column per level; levels are given, so no extra pass."""
    wide = df.groupBy(index).agg(
        *[F.avg(F.when(F.col(column) == F.lit(v), F.col(value))).alias(f"{prefix}{v}") for v in levels]
    )
    return wide.orderBy(index)


def sort_multi(df: DataFrame, *columns: str) -> DataFrame:
    return df.orderBy(*columns)


def argmax(df: DataFrame, item: str, score: str, name: str) -> DataFrame:
    """The item with the best score; the smallest item on ties."""
    return df.agg(F.max(F.struct(F.col(score).alias("s"), (-F.col(item)).alias("i"))).alias("b")).select(
        (-F.col("b.i")).alias(name), F.col("b.s").alias(score)
    )
