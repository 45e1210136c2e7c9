"""Encoding, splitting and scaling of model inputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aforo.functions.hashing import key_hash
from aforo.operators.selection import hash_share

TEST_SHARE = 0.2
SEED = 42


def label_indexer(columns: Sequence[str], suffix: str = "_idx") -> StringIndexer:
    """Alphabetical codes, fitted on all rows before the split."""
    return StringIndexer(
        inputCols=list(columns),
        outputCols=[c + suffix for c in columns],
        stringOrderType="alphabetAsc",
        handleInvalid="error",
    )


def label_encode(df: DataFrame, columns: Sequence[str], suffix: str = "_idx") -> DataFrame:
    return label_indexer(columns, suffix).fit(df).transform(df)


def ordinal(column: str) -> Column:
    """An index without its category metadata, so that trees split it as a number."""
    return F.col(column).cast("double").alias(column, metadata={})


def feature_vector(
    df: DataFrame, categorical: Sequence[str], numerics: Sequence[str], as_categories: bool
) -> DataFrame:
    """Indexed categories and numbers in one vector column ``features``.

    With ``as_categories`` the index keeps its metadata and tree learners treat
    it as unordered categories.
    """
    out = label_encode(df, categorical) if categorical else df
    indexed = [c + "_idx" for c in categorical]
    if not as_categories:
        out = out.withColumns({c: ordinal(c) for c in indexed})
    assembler = VectorAssembler(inputCols=[*indexed, *numerics], outputCol="features", handleInvalid="error")
    return Pipeline(stages=[assembler]).fit(out).transform(out)


def train_test_split(
    df: DataFrame, keys: Sequence[str], share: float = TEST_SHARE, seed: int = SEED
) -> tuple[DataFrame, DataFrame]:
    marked = df.withColumn("_h", key_hash(keys, seed, df))
    test = hash_share("_h", share)
    return marked.filter(~test).drop("_h"), marked.filter(test).drop("_h")


def scaling(df: DataFrame, features: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per feature; zero deviation becomes scale 1."""
    row = df.agg(
        *[F.avg(f).alias(f"m{i}") for i, f in enumerate(features)],
        *[F.stddev_pop(f).alias(f"s{i}") for i, f in enumerate(features)],
    ).first()
    return {f: (row[f"m{i}"] or 0.0, row[f"s{i}"] or 1.0) for i, f in enumerate(features)}


def apply_scaling(df: DataFrame, scales: dict[str, tuple[float, float]], prefix: str = "z_") -> DataFrame:
    return df.withColumns(
        {prefix + f: (F.col(f) - F.lit(mean)) / F.lit(std) for f, (mean, std) in scales.items()}
    )


def standardise(df: DataFrame, features: Sequence[str], prefix: str = "z_") -> DataFrame:
    return apply_scaling(df, scaling(df, features), prefix)
