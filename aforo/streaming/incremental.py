"""Scaler and k-means updated batch by batch with Structured Streaming.

State is a small table, one folder per micro-batch under ``state_path``. A batch
reads the folder of the batch before it and overwrites its own, so a replayed
batch is applied once. Only the last batch can be replayed, so the folders of
the last two batches stay and older ones are deleted. State size depends on
features and clusters only.

One query hands its state to the next as such a table: the scaler's last state
scales the rows of the k-means pass (``scales_of``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from aforo.functions.rows import drop_null_rows
from aforo.operators.clusters import assign_clusters
from aforo.operators.encode import apply_scaling
from aforo.session import remove_folder

SCALER_SCHEMA = "feature string, n long, mean double, m2 double"
CENTROID_SCHEMA = "cluster int, weight double, centre array<double>"
#: The file of a row, in the order in which files are read.
STEP = "_step"


def stream_table(
    spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 1, steps: bool = False
) -> DataFrame:
    """Files as batches; with ``steps`` rows keep their file, so that it stays a batch of its own for k-means."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    if steps:
        file = F.struct("_metadata.file_modification_time", "_metadata.file_path")
        stream = stream.select("*", file.alias(STEP))
    return stream


def _state(spark: SparkSession, state_path: str, batch_id: int, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{state_path}/batch={batch_id}")


def _store(state: DataFrame, state_path: str, batch_id: int) -> None:
    state.coalesce(1).write.mode("overwrite").parquet(f"{state_path}/batch={batch_id}")
    remove_folder(state.sparkSession, f"{state_path}/batch={batch_id - 2}")


def run_available(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> int:
    """Process everything there is, then stop; returns the last batch id, -1 if none ever ran."""
    query = (
        stream.writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    last = query.lastProgress
    return -1 if last is None else int(last["batchId"])


def latest_state(spark: SparkSession, state_path: str, schema: str) -> DataFrame:
    """The state after the newest batch."""
    every = spark.read.option("basePath", state_path).schema(f"{schema}, batch int").parquet(state_path)
    newest = every.agg(F.max("batch")).first()[0]
    return every.filter(F.col("batch") == newest).drop("batch")


def merge_moments(parts: DataFrame) -> DataFrame:
    """Pool (n, mean, m2) rows of the same feature."""
    pooled = parts.groupBy("feature").agg(
        F.sum("n").alias("n"),
        F.try_divide(F.sum(F.col("n") * F.col("mean")), F.sum("n")).alias("mean"),
        F.collect_list(F.struct("n", "mean", "m2")).alias("_p"),  # two rows per feature
    )
    m2 = F.aggregate(
        "_p",
        F.lit(0.0),
        lambda acc, p: acc + p["m2"] + p["n"] * (p["mean"] - F.col("mean")) * (p["mean"] - F.col("mean")),
    )
    return pooled.select("feature", "n", "mean", m2.alias("m2"))


def batch_moments(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    entries = F.array(
        *[
            F.struct(
                F.lit(f).alias("feature"),
                F.count(f).alias("n"),
                F.avg(f).alias("mean"),
                (F.var_pop(f) * F.count(f)).alias("m2"),
            )
            for f in features
        ]
    )
    return (
        rows.agg(entries.alias("_e")).select(F.explode("_e").alias("e")).select("e.*").filter(F.col("n") > 0)
    )


def standardise_incremental(
    stream: DataFrame, features: Sequence[str], state_path: str, checkpoint: str
) -> DataFrame:
    """Running mean and population deviation per feature over a stream of batches."""
    spark = stream.sparkSession

    def update(batch: DataFrame, batch_id: int) -> None:
        stats = batch_moments(drop_null_rows(batch, features), features)
        if batch_id > 0:
            stats = stats.unionByName(_state(batch.sparkSession, state_path, batch_id - 1, SCALER_SCHEMA))
        _store(merge_moments(stats), state_path, batch_id)

    run_available(stream, update, checkpoint)
    state = latest_state(spark, state_path, SCALER_SCHEMA)
    return state.select("feature", "n", "mean", F.sqrt(F.try_divide("m2", "n")).alias("std"))


def scales_of(scaler: DataFrame, features: Sequence[str]) -> dict[str, tuple[float, float]]:
    """What ``apply_scaling`` needs, from the last state of ``standardise_incremental``; one row per feature."""
    found = {r["feature"]: (r["mean"], r["std"] or 1.0) for r in scaler.collect()}
    return {f: found.get(f, (0.0, 1.0)) for f in features}


def minibatch_kmeans(
    stream: DataFrame,
    features: Sequence[str],
    scales: dict[str, tuple[float, float]],
    centroids: Sequence[Sequence[float]],
    state_path: str,
    checkpoint: str,
) -> DataFrame:
    """One pass of centroid updates: each batch pulls a centre by its share of all rows so far.

    A stream with ``steps`` may bring many small files at once. Each is still one step,
    from the centres that the file before left. Steps cannot run side by
    side, so the rows of such a batch pass one task in order, which holds the centres
    and one step's sums; files of many rows are better read one a batch, without ``steps``.
    """
    spark = stream.sparkSession
    columns = [f"z_{f}" for f in features]
    if STEP in stream.columns:
        return _small_steps(stream, features, scales, centroids, state_path, checkpoint)

    def start(session: SparkSession) -> DataFrame:
        rows = [(i, 0.0, [float(v) for v in c]) for i, c in enumerate(centroids)]
        return session.createDataFrame(rows, CENTROID_SCHEMA)

    def update(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        old = start(session) if batch_id == 0 else _state(session, state_path, batch_id - 1, CENTROID_SCHEMA)
        current = [r["centre"] for r in old.orderBy("cluster").collect()]  # k x d numbers
        rows = apply_scaling(drop_null_rows(batch, features), scales)
        sums = (
            assign_clusters(rows, columns, current)
            .groupBy("cluster")
            .agg(F.count(F.lit(1)).alias("_n"), F.array(*[F.sum(c) for c in columns]).alias("_s"))
        )
        # own names: inside a lambda, a name the select also defines would mean the new value
        before = old.select("cluster", F.col("weight").alias("_w"), F.col("centre").alias("_c"))
        new_weight = F.col("_w") + F.col("_n")
        moved = F.zip_with("_c", "_s", lambda c, s: (c * F.col("_w") + s) / new_weight)
        state = before.join(sums, "cluster", "left").select(
            "cluster",
            F.coalesce(new_weight, F.col("_w")).alias("weight"),
            F.coalesce(F.when(F.col("_n") > 0, moved), F.col("_c")).alias("centre"),
        )
        _store(state, state_path, batch_id)

    run_available(stream, update, checkpoint)
    return latest_state(spark, state_path, CENTROID_SCHEMA)


def _small_steps(stream, features, scales, centroids, state_path: str, checkpoint: str) -> DataFrame:
    columns = [f"z_{f}" for f in features]

    def update(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        old = [(i, 0.0, [float(v) for v in c]) for i, c in enumerate(centroids)]
        if batch_id > 0:
            before = _state(session, state_path, batch_id - 1, CENTROID_SCHEMA).orderBy("cluster")
            old = [tuple(r) for r in before.collect()]  # k x d numbers
        rows = apply_scaling(drop_null_rows(batch, features), scales)
        rows = rows.select(F.to_json(STEP).alias("_file"), STEP, *columns).repartition(1).sortWithinPartitions(STEP)
        found = rows.drop(STEP).mapInPandas(_fold(old, columns), CENTROID_SCHEMA).collect()
        # without rows there may be no task, then the centres stay
        _store(session.createDataFrame(found or old, CENTROID_SCHEMA), state_path, batch_id)

    run_available(stream, update, checkpoint)
    return latest_state(stream.sparkSession, state_path, CENTROID_SCHEMA)


def _fold(old: Sequence[tuple], columns: Sequence[str]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Moves the centres file by file; a file's rows are all assigned to the centres before it."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weight, centre = np.array([r[1] for r in old]), np.array([r[2] for r in old])
        count, total, now = np.zeros(len(old)), np.zeros_like(centre), None

        def step() -> None:
            hit = count > 0
            centre[hit] = (centre[hit] * weight[hit, None] + total[hit]) / (weight + count)[hit, None]
            weight[:] += count
            count[:], total[:] = 0.0, 0.0

        for batch in batches:
            for file, part in batch.groupby("_file", sort=False):
                if now is not None and file != now:
                    step()
                now = file
                x = part[list(columns)].to_numpy(dtype=float)
                label = ((x[:, None] - centre[None]) ** 2).sum(axis=2).argmin(axis=1)
                np.add.at(count, label, 1.0)
                np.add.at(total, label, x)
        step()
        yield pd.DataFrame({"cluster": [r[0] for r in old], "weight": weight, "centre": centre.tolist()})

    return fold
