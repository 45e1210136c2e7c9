"""Row filters and column selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aforo import schema as S


def filter_eq(df: DataFrame, column: str, value) -> DataFrame:
    return df.filter(F.col(column) == F.lit(value))


def filter_lt(df: DataFrame, column: str, value) -> DataFrame:
    return df.filter(F.col(column) < F.lit(value))


def drop_null_rows(df: DataFrame, subset: Sequence[str]) -> DataFrame:
    """Keep the rows where every column of the subset is present (and not NaN)."""
    return df.dropna(how="any", subset=list(subset))


def present(df: DataFrame, wanted: Sequence[str]) -> list[str]:
    """The wanted columns that the frame has, in the wanted order."""
    return [c for c in wanted if c in df.columns]


def select_features(
    df: DataFrame, table: str, use: str = "regression", keep: Sequence[str] = ()
) -> DataFrame:
    """Project to the model columns of table A, B or C that exist, plus ``keep``."""
    if use == "regression":
        wanted = [S.TARGET, *S.REGRESSION_CATEGORICAL[table], *S.REGRESSION_NUMERIC[table]]
    elif use == "clustering":
        wanted = S.CLUSTER_FEATURES[table]
    elif use == "anomalies":
        wanted = S.ANOMALY_FEATURES[table]
    else:
        raise ValueError(f"unknown use {use!r}")
    ordered = [*keep, *[c for c in wanted if c not in keep]]
    return df.select(*present(df, ordered))
