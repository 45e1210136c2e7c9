"""Isolation forest (Liu, Ting and Zhou, 2008) as Spark jobs.

Trees are built one per group from a fixed number of rows; scoring passes over
all rows with the small node table broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aforo.functions.hashing import MODULUS, key_hash
from aforo.functions.rows import drop_null_rows
from aforo.operators.quantiles import group_quantiles
from aforo.session import checkpoint_dir
from aforo.sources.billing import sample_rows

N_TREES = 100
SAMPLE_SIZE = 256
SEED = 42
CONTAMINATION = 0.01
EULER = 0.5772156649015329
#: A mean or deviation is exact to some units in the last place, so a value this near a threshold lies on it.
ROUNDING = 1e-12

NODE_SCHEMA = (
    "tree_id int, node_id int, feature int, threshold double, left int, right int, "
    "depth int, size int"
)


def mean_path(n: float) -> float:
    """Average path length of an unsuccessful search among n points."""
    if n <= 1:
        return 0.0
    if n <= 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + EULER) - 2.0 * (n - 1.0) / n


def _grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple]:
    """Nodes of one random tree, parents before children; feature -1 marks a leaf."""
    nodes: list[list] = []
    todo = [(np.arange(len(x)), 0, -1, "")]
    while todo:
        rows, depth, parent, side = todo.pop()
        me = len(nodes)
        nodes.append([me, -1, 0.0, -1, -1, depth, len(rows)])
        if parent >= 0:
            nodes[parent][3 if side == "left" else 4] = me
        if depth >= limit or len(rows) <= 1:
            continue
        low, high = x[rows].min(axis=0), x[rows].max(axis=0)
        usable = np.flatnonzero(high > low)
        if usable.size == 0:
            continue
        f = int(rng.choice(usable))
        cut = float(rng.uniform(low[f], high[f]))
        goes_left = x[rows, f] <= cut
        nodes[me][1], nodes[me][2] = f, cut
        todo.append((rows[~goes_left], depth + 1, me, "right"))
        todo.append((rows[goes_left], depth + 1, me, "left"))
    return [tuple(n) for n in nodes]


def tree_samples(
    df: DataFrame, keys: Sequence[str], n_trees: int, sample_size: int, seed: int
) -> DataFrame:
    """``sample_size`` rows per tree without replacement, by hash of (tree, key).

    A pool of n_trees x sample_size rows is drawn first, so the number of rows
    paired with trees is a constant, whatever the size of the input.
    """
    pool = sample_rows(df, n_trees * sample_size, keys, seed)
    checkpoint_dir(df.sparkSession)
    pool = pool.repartition(max(1, min(n_trees, df.sparkSession.sparkContext.defaultParallelism))).checkpoint()
    n = max(pool.count(), 1)
    share = min(1.0, 2.0 * sample_size / n) if n > 2 * sample_size else 1.0
    paired = pool.withColumn("tree_id", F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1))))
    hashed = paired.withColumn("_h", key_hash([*keys, "tree_id"], seed, paired)).filter(
        F.col("_h") <= int(share * MODULUS)
    )
    rank = Window.partitionBy("tree_id").orderBy("_h", *keys)
    return (
        hashed.withColumn("_r", F.row_number().over(rank)).filter(F.col("_r") <= sample_size).drop("_h", "_r")
    )


def isolation_forest_fit(
    df: DataFrame,
    features: Sequence[str],
    keys: Sequence[str],
    n_trees: int = N_TREES,
    sample_size: int = SAMPLE_SIZE,
    seed: int = SEED,
) -> DataFrame:
    """The node table of the forest, at most n_trees x (2 x sample_size - 1) rows.

    A split is drawn between a feature's extremes, so rescaling the features
    changes nothing and the scaling pass is left out.
    """
    features, keys = list(features), list(keys)
    rows = drop_null_rows(df.select(*keys, *[F.col(f).cast("double").alias(f) for f in features if f not in keys]),
                          features)
    limit = math.ceil(math.log2(max(sample_size, 2)))

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(key[0])
        ordered = pdf.sort_values(keys)[features].to_numpy(dtype=float)
        nodes = _grow(ordered, np.random.default_rng([seed, tree]), limit)
        out = pd.DataFrame(
            nodes, columns=["node_id", "feature", "threshold", "left", "right", "depth", "size"]
        )
        out.insert(0, "tree_id", tree)
        return out

    samples = tree_samples(rows, keys, n_trees, sample_size, seed)
    return samples.groupBy("tree_id").applyInPandas(build, NODE_SCHEMA)


def forest_shape(nodes: DataFrame) -> DataFrame:
    """What must hold of any forest: trees, rows at the roots, depth, and parents whose children lack or add rows."""
    child = nodes.select("tree_id", F.col("node_id").alias("_child"), F.col("size").alias("_size"), F.col("depth").alias("_depth"))
    parents = nodes.filter("feature >= 0").select("tree_id", "node_id", "size", "depth", F.explode(F.array("left", "right")).alias("_child"))
    sums = parents.join(child, ["tree_id", "_child"], "left").groupBy("tree_id", "node_id", "size", "depth").agg(
        F.sum("_size").alias("_sum"), F.min("_depth").alias("_d")
    )
    wrong = sums.filter(~(F.col("_sum").eqNullSafe(F.col("size")) & F.col("_d").eqNullSafe(F.col("depth") + 1)))
    shape = nodes.agg(
        F.count_distinct("tree_id").alias("n_trees"),
        F.min(F.when(F.col("depth") == 0, F.col("size"))).cast("long").alias("root_min"),
        F.max(F.when(F.col("depth") == 0, F.col("size"))).cast("long").alias("root_max"),
        F.max("depth").alias("depth"),
        F.sum(F.when(F.col("feature") < 0, F.col("size"))).alias("leaf_rows"),
    )
    return shape.crossJoin(wrong.agg(F.count(F.lit(1)).alias("wrong_parents")))  # one row each


def isolation_forest_score(
    df: DataFrame, features: Sequence[str], nodes: DataFrame, n_trees: int = N_TREES,
    sample_size: int = SAMPLE_SIZE,
) -> DataFrame:
    """Add ``score`` in (0, 1): 2 to the minus mean path over the expected path.

    A feature that equals a threshold but for rounding goes left, whatever the order
    in which its records were added up.
    """
    bound = n_trees * (2 * sample_size - 1)
    table = nodes.limit(bound + 1).toPandas()
    if len(table) > bound:
        raise ValueError("node table larger than the forest allows")
    n_trees = int(table["tree_id"].max()) + 1
    width = int(table["node_id"].max()) + 1
    t, i = table["tree_id"].to_numpy(), table["node_id"].to_numpy()

    def grid(values, dtype):
        out = np.zeros((n_trees, width), dtype=dtype)
        out[t, i] = values
        return out

    leaf_path = table["depth"] + table["size"].map(mean_path)
    roots = table[table["depth"] == 0]["size"]
    expected = mean_path(float(roots.mean()))
    depth = int(table["depth"].max())
    limits = table["threshold"] + ROUNDING * table["threshold"].abs()
    forest = (
        grid(table["feature"], np.int32), grid(limits, float), grid(table["left"], np.int32),
        grid(table["right"], np.int32), grid(leaf_path, float),
    )
    shared = df.sparkSession.sparkContext.broadcast(forest)
    names = list(features)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Only the features leave Arrow; all other columns pass as they are."""
        feature, threshold, left, right, path = shared.value
        for batch in batches:
            x = np.empty((batch.num_rows, len(names)))
            for i, name in enumerate(names):
                x[:, i] = batch.column(name).to_numpy(zero_copy_only=False).astype(float)
            row = np.arange(len(x))
            total = np.zeros(len(x))
            for tree in range(n_trees):
                at = np.zeros(len(x), dtype=np.int32)
                for _ in range(depth):
                    f = feature[tree, at]
                    go_left = x[row, np.maximum(f, 0)] <= threshold[tree, at]
                    at = np.where(f < 0, at, np.where(go_left, left[tree, at], right[tree, at]))
                total += path[tree, at]
            found = np.power(2.0, -total / n_trees / expected) if expected else np.ones(len(x))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], [*batch.schema.names, "score"])

    rows = drop_null_rows(df, names)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(score, f"{schema}, score double")


def contamination_cut(
    scored: DataFrame, score: str = "score", contamination: float = CONTAMINATION
) -> DataFrame:
    """Flag the rows above the exact (1 - contamination) quantile of the score."""
    cut = group_quantiles(scored.select(score), [], score, {"cut": 1.0 - contamination}).first()["cut"]
    shifted = F.col(score) - F.lit(cut)
    return scored.withColumns({"anomaly_score": shifted, "es_anomalia": shifted > 0})


def detect_anomalies(
    df: DataFrame, features: Sequence[str], keys: Sequence[str], contamination: float = CONTAMINATION,
    n_trees: int = N_TREES, sample_size: int = SAMPLE_SIZE, seed: int = SEED,
) -> DataFrame:
    """Fit, score and flag. Scores are stored once, since the cut and the output both read them."""
    checkpoint_dir(df.sparkSession)
    rows = drop_null_rows(df.select(*keys, *[f for f in features if f not in keys]), features).checkpoint()
    nodes = isolation_forest_fit(rows, features, keys, n_trees, sample_size, seed)
    scored = isolation_forest_score(rows, features, nodes, n_trees, sample_size).checkpoint()
    return contamination_cut(scored, "score", contamination)


def top_anomalies(flagged: DataFrame, keys: Sequence[str], n: int = 10) -> DataFrame:
    return flagged.filter("es_anomalia").orderBy(F.desc("anomaly_score"), *keys).limit(n)


def anomaly_comparison(flagged: DataFrame, features: Sequence[str], flag: str = "es_anomalia") -> DataFrame:
    """Per feature: normal mean, anomalous mean and their ratio, in one aggregation."""
    f_col = F.col(flag)
    means = flagged.agg(
        F.count(F.lit(1)).alias("n_total"),
        F.count_if(f_col).alias("n_anomalias"),
        F.array(
            *[
                F.struct(
                    F.lit(f).alias("feature"),
                    F.avg(F.when(~f_col, F.col(f))).alias("normal"),
                    F.avg(F.when(f_col, F.col(f))).alias("anomalia"),
                )
                for f in features
            ]
        ).alias("_f"),
    )
    ratio = F.when(F.col("normal") == 0, F.lit(0.0)).otherwise(
        F.try_divide(F.col("anomalia"), F.col("normal"))
    )
    return means.select("n_total", "n_anomalias", F.explode("_f").alias("e")).select(
        "e.feature", "e.normal", "e.anomalia", "n_total", "n_anomalias"
    ).withColumns({
        "ratio": ratio,
        "pct_anomalias": F.try_divide(F.col("n_anomalias") * 100.0, F.col("n_total")),
    })
