"""Boosted regression trees on the feature tables, with metrics and importances."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aforo import schema as S
from aforo.functions.hashing import key_hash
from aforo.functions.rows import drop_null_rows, present
from aforo.operators.encode import feature_vector, train_test_split
from aforo.session import checkpoint_dir, scratch_path, stored_for_passes

# The two published parameter sets.
BOOSTED = {"maxIter": 100, "maxDepth": 6, "stepSize": 0.1, "seed": 42, "maxBins": 256}
BOOSTED_SAMPLED = {
    "maxIter": 300,
    "maxDepth": 6,
    "stepSize": 0.05,
    "subsamplingRate": 0.8,
    "featureSubsetStrategy": "0.8",
    "maxBins": 255,
    "seed": 42,
}


@dataclass
class Boosted:
    model: GBTRegressionModel
    features: list[str]
    predictions: DataFrame
    n_train: int
    n_test: int


def _inputs(df: DataFrame, table: str) -> tuple[list[str], list[str]]:
    return present(df, S.REGRESSION_CATEGORICAL[table]), present(df, S.REGRESSION_NUMERIC[table])


def _fit(df: DataFrame, table: str, keys: Sequence[str], as_categories: bool, params: dict) -> Boosted:
    categorical, numerics = _inputs(df, table)
    rows = drop_null_rows(df.select(*keys, *[c for c in [S.TARGET, *categorical, *numerics] if c not in keys]),
                          [S.TARGET, *categorical, *numerics])
    # The frame is scanned once per boosting level; checkpoints cut the lineage
    # that boosting would otherwise grow by one step per tree. Walking a tree of
    # six levels is cheaper than a table of node ids for every level.
    checkpoint_dir(df.sparkSession)
    rows = stored_for_passes(rows, "tree-rows", keys).persist()
    ready = feature_vector(rows, categorical, numerics, as_categories)
    train, test = train_test_split(ready.select(*keys, S.TARGET, "features"), keys)
    train = train.persist()
    n_train = train.count()
    gbt = GBTRegressor(
        labelCol=S.TARGET, featuresCol="features", cacheNodeIds=False, checkpointInterval=10,
        maxMemoryInMB=512, **params,
    )
    model = gbt.fit(train)
    train.unpersist()
    predictions = model.transform(test).select(*keys, S.TARGET, "prediction").checkpoint()
    rows.unpersist()
    return Boosted(model, [*categorical, *numerics], predictions, n_train, predictions.count())


def boosted_trees(df: DataFrame, table: str, keys: Sequence[str] | None = None, **overrides) -> Boosted:
    """Label-encoded boosting: categories split as ordered codes."""
    return _fit(df, table, keys or S.FEATURE_TABLE_KEYS[table], False, {**BOOSTED, **overrides})


def boosted_trees_sampled(
    df: DataFrame, table: str, keys: Sequence[str] | None = None, **overrides
) -> Boosted:
    """Boosting with native categories and row and feature sampling.

    Level-wise growth to depth 6 gives at most 64 leaves, close to a leaf-wise
    limit of 63.
    """
    return _fit(df, table, keys or S.FEATURE_TABLE_KEYS[table], True, {**BOOSTED_SAMPLED, **overrides})


def out_of_fold(
    df: DataFrame, table: str, folds: int = 5, keys: Sequence[str] | None = None, seed: int = 42, **overrides
) -> DataFrame:
    """A prediction for every complete row, by a model that was not fitted on it.

    The fold of a row is its key hash, so rows of one key are held out together.
    """
    keys = list(keys or S.FEATURE_TABLE_KEYS[table])
    categorical, numerics = _inputs(df, table)
    wanted = [S.TARGET, *categorical, *numerics]
    rows = drop_null_rows(df.select(*keys, *[c for c in wanted if c not in keys]), wanted)
    checkpoint_dir(df.sparkSession)
    rows = stored_for_passes(rows, "tree-rows", keys)
    ready = feature_vector(rows, categorical, numerics, False).withColumn("fold", (key_hash(keys, seed, rows) % folds).cast("int"))
    ready = ready.select(*keys, S.TARGET, "features", "fold").persist()
    gbt = GBTRegressor(
        labelCol=S.TARGET, featuresCol="features", cacheNodeIds=False, checkpointInterval=10, maxMemoryInMB=512,
        **{**BOOSTED, **overrides},
    )
    try:
        parts = [
            gbt.fit(ready.filter(F.col("fold") != fold)).transform(ready.filter(F.col("fold") == fold)).select(*keys, S.TARGET, "fold", "prediction")
            for fold in range(folds)
        ]
        return reduce(DataFrame.unionByName, parts).checkpoint()
    finally:
        ready.unpersist()


def regression_metrics(predictions: DataFrame, actual: str = S.TARGET, predicted: str = "prediction") -> DataFrame:
    """RMSE, MAE and R2 in one aggregation."""
    error = F.col(actual) - F.col(predicted)
    return predictions.agg(
        F.count(F.lit(1)).alias("n"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(F.abs(error)).alias("mae"),
        (1 - F.try_divide(F.avg(error * error), F.var_pop(actual))).alias("r2"),
    )


def feature_importance(fit: Boosted, spark) -> DataFrame:
    """Gain share per feature."""
    values = fit.model.featureImportances.toArray()
    return spark.createDataFrame(
        [(f, float(v)) for f, v in zip(fit.features, values)], "feature string, importance double"
    )


def split_counts(fit: Boosted, spark) -> DataFrame:
    """Number of splits per feature, read from the stored model."""
    path = scratch_path(spark, "model")
    fit.model.write().save(path)
    names = spark.createDataFrame(list(enumerate(fit.features)), "feature_index int, feature string")
    splits = (
        spark.read.parquet(f"{path}/data")
        .select("nodeData.*")
        .filter(F.col("leftChild") >= 0)
        .groupBy(F.col("split.featureIndex").alias("feature_index"))
        .agg(F.count(F.lit(1)).alias("splits"))
    )
    return names.join(splits, "feature_index", "left").select(
        "feature", F.coalesce("splits", F.lit(0)).alias("splits")
    )


def importance_rank(importances: DataFrame, value: str = "importance") -> DataFrame:
    return importances.orderBy(F.desc(value), "feature")
