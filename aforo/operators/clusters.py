"""Segmentation: k-means, choice of k by silhouette, assignment and profiles."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel, inheritable_thread_target
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aforo.functions.rows import drop_null_rows
from aforo.operators.encode import apply_scaling, scaling
from aforo.session import stored_for_passes
from aforo.sources.billing import sample_rows

SEED = 42
K_MIN, K_MAX = 2, 8
N_INIT = 10
MAX_ITER = 300
TOLERANCE = 1e-4
PARALLEL_FITS = 8
#: Tasks for each core that fits side by side may keep waiting; each fit holds a copy of the vectors.
WAITING_TASKS = 8
#: Distances and points that a step of many fits holds at once.
DISTANCES, POINTS = 1 << 19, 1024
#: Starting centres lie far from zero if their mean is so many times their range.
FAR = 100.0
#: Bytes of points that one task of a step reads.
TASK_BYTES = 64 << 20


def scaled_vectors(df: DataFrame, features: Sequence[str], scales=None) -> DataFrame:
    """Rows complete in the features, with the scaled vector column ``zvec``."""
    rows = drop_null_rows(df, features)
    scales = scales or scaling(rows, features)
    z = apply_scaling(rows, scales)
    out = VectorAssembler(inputCols=[f"z_{f}" for f in features], outputCol="zvec").transform(z)
    return out.drop(*[f"z_{f}" for f in features])


def kmeans(
    vectors: DataFrame, k: int, seed: int = SEED, n_init: int = N_INIT, max_iter: int = MAX_ITER, tol: float = TOLERANCE
) -> KMeansModel:
    """The best of ``n_init`` restarts by training cost; lay the vectors out by ``stored_for_passes`` and persist them first.

    A fit ends when no centre moves by more than ``tol``.
    """

    def fit(s: int) -> KMeansModel:
        return KMeans(k=k, seed=s, maxIter=max_iter, tol=tol, featuresCol="zvec", predictionCol="cluster").fit(vectors)

    models = _in_parallel(fit, [seed + i for i in range(n_init)], vectors)
    return min(models, key=lambda m: m.summary.trainingCost)


def _in_parallel(task, arguments, df: DataFrame, at_once: int = PARALLEL_FITS) -> list:
    """Independent fits submitted side by side, so that small jobs fill the cluster."""
    pool = ThreadPool(min(at_once, len(arguments)))
    try:
        return pool.map(inheritable_thread_target(df.sparkSession)(task), arguments)
    finally:
        pool.close()


def silhouette(labelled: DataFrame, features_col: str = "zvec", label: str = "cluster") -> float:
    """Mean silhouette in squared distance: linear cost, any number of rows."""
    evaluator = ClusteringEvaluator(featuresCol=features_col, predictionCol=label)
    return evaluator.evaluate(labelled)


def silhouette_sample(
    labelled: DataFrame, keys: Sequence[str], labels: Sequence[str], max_rows: int, seed: int = SEED
) -> DataFrame:
    """Mean Euclidean silhouette of a seeded sample, for several labellings at once.

    Every pair of sampled rows is compared, so the caller states the size; for a
    value over all rows use :func:`silhouette`. The sample is
    the broadcast side; tasks compare slices of it with the whole and emit one
    row per sampled row.
    """
    spark = labelled.sparkSession
    sample = sample_rows(labelled, max_rows, keys, seed).select(
        vector_to_array("zvec").alias("x"), *[F.col(c).cast("int").alias(c) for c in labels]
    ).persist()
    whole = sample.toPandas()  # at most max_rows rows
    if whole.empty:
        return spark.createDataFrame([], "labelling string, silhouette_sample double, n_sample long")
    points = np.vstack(whole["x"].to_numpy())
    shared = spark.sparkContext.broadcast((points, {c: whole[c].to_numpy() for c in labels}))
    names = list(labels)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pts, labs = shared.value
        norms = (pts**2).sum(axis=1)
        members = {c: np.eye(labs[c].max() + 1)[labs[c]] for c in names}
        sizes = {c: members[c].sum(axis=0) for c in names}
        for batch in batches:
            for start in range(0, len(batch), 256):
                part = batch.iloc[start : start + 256]
                x = np.vstack(part["x"].to_numpy())
                d = np.sqrt(np.maximum((x**2).sum(axis=1)[:, None] + norms - 2 * x @ pts.T, 0.0))
                out = {}
                for c in names:
                    own = part[c].to_numpy()
                    row = np.arange(len(own))
                    totals = d @ members[c]
                    inner = totals[row, own] / np.maximum(sizes[c][own] - 1, 1)
                    means = np.where(sizes[c] > 0, totals / np.maximum(sizes[c], 1), np.inf)
                    means[row, own] = np.inf
                    outer = means.min(axis=1)
                    s = (outer - inner) / np.maximum(np.maximum(inner, outer), 1e-300)
                    out[c] = np.where((sizes[c][own] > 1) & np.isfinite(outer), s, 0.0)
                yield pd.DataFrame(out)

    scores = sample.repartition(spark.sparkContext.defaultParallelism).mapInPandas(
        compare, ", ".join(f"{c} double" for c in names)
    )
    means = scores.agg(*[F.avg(c).alias(c) for c in names], F.count(F.lit(1)).alias("n")).first()
    sample.unpersist()
    return spark.createDataFrame(
        [(c, means[c], means["n"]) for c in names], "labelling string, silhouette_sample double, n_sample long"
    )


def best_k_search(
    vectors: DataFrame,
    keys: Sequence[str],
    k_min: int = K_MIN,
    k_max: int = K_MAX,
    n_init: int = N_INIT,
    seed: int = SEED,
    tol: float = TOLERANCE,
) -> DataFrame:
    """Silhouette per k, fitted and scored on all rows; k stays below the number of rows.

    The silhouette is the one in squared distance, whose cost is linear.
    """
    rows = stored_for_passes(vectors.select(*keys, "zvec"), "vectors", keys).persist()
    try:
        n = rows.count()
        ks = [k for k in range(k_min, k_max + 1) if k < n]
        starts = starting_centres(rows, [(k, seed + i) for k in ks for i in range(n_init)])
        fits = fit_together(rows, starts, MAX_ITER, tol)
        best = [min(fits[i * n_init : (i + 1) * n_init], key=lambda fit: fit[1])[0] for i in range(len(ks))]
        labelled = _labelled(rows, best).persist()
        try:
            # equal points can leave fewer centres than asked for, at worst one
            values = _in_parallel(
                lambda i: silhouette(labelled, label=f"cluster_{i}") if len(best[i]) > 1 else 0.0, range(len(ks)), rows
            )
        finally:
            labelled.unpersist()
    finally:
        rows.unpersist()
    scores = [(k, value, n) for k, value in zip(ks, values)]
    return vectors.sparkSession.createDataFrame(scores, "k int, silhouette double, n long")


def starting_centres(rows: DataFrame, fits: Sequence[tuple[int, int]]) -> list[list[np.ndarray]]:
    """MLlib's k-means|| centres for pairs of k and seed; ``rows`` are persisted.

    MLlib decodes rows that are persisted themselves in each of its passes. A projection of them
    it keeps decoded, so only as many fits run at once as fill the cores. ``solver`` is the one of
    persisted rows.
    """
    bare = rows.select("zvec")
    cores = rows.sparkSession.sparkContext.defaultParallelism
    at_once = min(PARALLEL_FITS, max(1, WAITING_TASKS * cores // bare.rdd.getNumPartitions()))

    def start(fit: tuple[int, int]) -> list[np.ndarray]:
        means = KMeans(k=fit[0], seed=fit[1], maxIter=0, solver="row", featuresCol="zvec", predictionCol="cluster")
        return means.fit(bare).clusterCenters()

    return _in_parallel(start, fits, rows, at_once)


def fit_together(
    rows: DataFrame, starts: Sequence[Sequence[np.ndarray]], max_iter: int = MAX_ITER, tol: float = TOLERANCE
) -> list[tuple[np.ndarray, float]]:
    """Centres and cost of k-means from many sets of starting centres; a pass over ``rows`` is a step of all fits.

    Each fit does what MLlib does: a row goes to its nearest centre, the first one on ties, a
    centre without rows stays, and the fit ends when no centre moves by more than ``tol``. Its
    cost is that of the last assignment.
    """
    first = np.vstack([np.asarray(c) for c in starts])
    # squares of values far from zero would lose the digits that tell centres apart
    far = np.abs(first.mean(axis=0)) > FAR * np.ptp(first, axis=0)
    origin = np.where(far, first.mean(axis=0), 0.0)
    points = _matrices(rows, origin).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        offset = points.map(lambda m: float((m[:-1] ** 2).sum())).sum()
        centres = [np.asarray(c) - origin for c in starts]
        costs = [0.0] * len(centres)
        # fits of equally many centres lie side by side
        moving = sorted(range(len(centres)), key=lambda i: len(centres[i]))
        for _ in range(max_iter):
            if not moving:
                break
            parts = points.mapPartitions(_nearest_sums([centres[i] for i in moving])).collect()
            sums, cost = sum(p[0] for p in parts), sum(p[1] for p in parts)
            still, at = [], 0
            for i, c in zip(moving, cost):
                old = centres[i]
                own = sums[at : at + len(old)]
                at += len(old)
                count = own[:, -1:]
                centres[i] = np.where(count > 0, own[:, :-1] / np.maximum(count, 1), old)
                costs[i] = float(c) + offset
                if (((centres[i] - old) ** 2).sum(axis=1) > tol * tol).any():
                    still.append(i)
            moving = still
    finally:
        points.unpersist()
    return [(c + origin, cost) for c, cost in zip(centres, costs)]


def _matrices(rows: DataFrame, origin: np.ndarray) -> RDD:
    """The vectors less ``origin`` as columns of matrices, with a last row of ones.

    A task of Python costs some 0.1 s whatever it does, so tasks are as many as cores, or a
    multiple of that where they would read more than ``TASK_BYTES``.
    """
    height = len(origin) + 1
    width = max(1, min(POINTS, DISTANCES // height))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) - origin
            for start in range(0, len(x), width):
                part = x[start : start + width]
                matrix = np.vstack([part.T, np.ones(len(part))])
                yield pa.RecordBatch.from_pydict({"m": pa.array([matrix.tobytes()], pa.binary())})

    packed = rows.select(vector_to_array("zvec").alias("x")).mapInArrow(pack, "m binary")
    tasks, cores = rows.rdd.getNumPartitions(), rows.sparkSession.sparkContext.defaultParallelism
    if tasks > cores:
        tasks = cores * max(1, math.ceil(rows.count() * height * 8 / (cores * TASK_BYTES)))
        packed = packed.repartition(tasks)
    return packed.rdd.map(lambda r: np.frombuffer(r["m"]).reshape(height, -1))


def _nearest_sums(centres: Sequence[np.ndarray]) -> Callable[[Iterator[np.ndarray]], Iterator[tuple]]:
    """For the matrices of a task: sum and number of the points nearest to each centre, and each fit's cost.

    The cost lacks the points' own squares. Fits come in order of their numbers of centres.
    """
    flat = np.vstack(centres)
    squares = (flat**2).sum(axis=1)
    groups = []  # rows of distances, their fits, centres of each
    at = 0
    for i, c in enumerate(centres):
        first = np.unique(c, axis=0, return_index=True)[1]
        repeated = np.setdiff1d(np.arange(len(c)), first)
        squares[at + repeated] = np.inf  # the first of equal centres takes the rows
        if groups and groups[-1][2] == len(c):
            groups[-1] = (slice(groups[-1][0].start, at + len(c)), slice(groups[-1][1].start, i + 1), len(c))
        else:
            groups.append((slice(at, at + len(c)), slice(i, i + 1), len(c)))
        at += len(c)
    weights = np.column_stack([-2 * flat, squares])
    n_fits, width = len(centres), min(POINTS, max(64, DISTANCES // len(flat)))

    def run(matrices: Iterator[np.ndarray]) -> Iterator[tuple]:
        sums, cost = np.zeros(weights.shape), np.zeros(n_fits)
        for matrix in matrices:
            for start in range(0, matrix.shape[1], width):
                x = matrix[:, start : start + width]
                for lines, fits, k in groups:
                    d = (weights[lines] @ x).reshape(-1, k, x.shape[1])
                    least = d.min(axis=1)
                    cost[fits] += least.sum(axis=1)
                    hit = d == least[:, None]
                    own = hit.reshape(-1, x.shape[1]).astype(float) @ x.T
                    counts = own[:, -1].reshape(-1, k).sum(axis=1)
                    for f in np.flatnonzero(counts > x.shape[1]):  # ties go to the first centre
                        own[f * k : (f + 1) * k] = (hit[f].argmax(axis=0) == np.arange(k)[:, None]).astype(float) @ x.T
                    sums[lines] += own
        yield sums, cost

    return run


def _labelled(rows: DataFrame, models: Sequence[np.ndarray]) -> DataFrame:
    """The vectors with the nearest centre of each model in ``cluster_0``, ``cluster_1``, ..."""

    @F.pandas_udf("array<int>")
    def nearest(vectors: pd.Series) -> pd.Series:
        if vectors.empty:
            return pd.Series([], dtype=object)
        x = np.vstack(vectors.to_numpy())
        out = []
        for centres in models:
            label, least = np.zeros(len(x), dtype=np.int32), np.full(len(x), np.inf)
            for i, c in enumerate(centres):
                d = ((x - c) ** 2).sum(axis=1)
                label[d < least] = i
                least = np.minimum(least, d)
            out.append(label)
        return pd.Series(list(np.stack(out, axis=1)))

    wide = rows.select("zvec", nearest(vector_to_array("zvec")).alias("_labels"))
    return wide.select("zvec", *[F.col("_labels")[i].alias(f"cluster_{i}") for i in range(len(models))])


def silhouette_by_k(df: DataFrame, columns: Sequence[str], centroids: dict[int, Sequence[Sequence[float]]]) -> DataFrame:
    """Silhouette over all rows of given centres, per number of clusters."""
    rows = VectorAssembler(inputCols=list(columns), outputCol="zvec").transform(df).persist()
    try:
        scores = [
            (k, silhouette(assign_clusters(rows, columns, centres).withColumn("cluster", F.col("cluster").cast("double"))))
            for k, centres in centroids.items()
        ]
    finally:
        rows.unpersist()
    return df.sparkSession.createDataFrame(scores, "k int, silhouette double")


def squared_distance(columns: Sequence[str], centroid: Sequence[float]) -> Column:
    total = F.lit(0.0)
    for c, v in zip(columns, centroid):
        d = F.col(c) - F.lit(float(v))
        total = total + d * d
    return total


def assign_clusters(
    df: DataFrame, columns: Sequence[str], centroids: Sequence[Sequence[float]], name: str = "cluster"
) -> DataFrame:
    """Nearest centroid per row as one generated expression; the lowest index on ties."""
    candidates = [
        F.struct(squared_distance(columns, c).alias("d"), F.lit(i).alias("k"))
        for i, c in enumerate(centroids)
    ]
    return df.withColumn(name, F.array_min(F.array(*candidates))["k"])


def _share(keys: Sequence[str], columns: Sequence[str], seed: int) -> Column:
    """A number in [0, 1) that key and values alone decide, so equal rows are drawn together."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys, *columns), 11) / F.lit(float(1 << 53))


def start_centres(
    df: DataFrame, columns: Sequence[str], k: int, keys: Sequence[str], seed: int = SEED, rounds: int = 5
) -> list[list[float]]:
    """At most ``k`` distinct starting centres by k-means||, the same for every layout of the rows.

    Each round draws about 2 k rows, every one by chance in proportion to its
    squared distance from the points drawn so far; a hash of key and values is
    the die, so the rows of a repeated key and value are drawn together. The points, weighted by the rows nearest to them, are then reduced
    to ``k`` on the driver, which sees some 2 k x ``rounds`` points and a sum a
    round. Store or persist ``df``: it is read twice a round.
    """
    columns = list(columns)
    order = [F.col("_u"), *columns]
    first = df.withColumn("_u", _share(keys, columns, seed)).select("_u", *columns).orderBy(*order).limit(1).collect()
    points = [tuple(float(r[c]) for c in columns) for r in first]
    for turn in range(rounds if points else 0):
        near = F.array_min(F.array(*[squared_distance(columns, p) for p in points]))
        die = _share(keys, columns, seed + 1 + turn)
        # the likeliest row is taken in any case, so each round adds a point while any is left
        likeliest = F.min_by(F.struct(*columns), F.when(near > 0, die / near))
        cost, sure = df.agg(F.sum(near), likeliest).first()
        if not cost:
            break
        drawn = df.filter(die < F.lit(2.0 * k / cost) * near).select(*columns).distinct().collect()
        points += sorted({tuple(float(r[c]) for c in columns) for r in [*drawn, sure]})
    counts = {r["_c"]: r["count"] for r in assign_clusters(df, columns, points, "_c").groupBy("_c").count().collect()} if points else {}
    return _reduce(np.array(points), np.array([float(counts.get(i, 0)) for i in range(len(points))]), k, seed)


def _reduce(points: np.ndarray, weights: np.ndarray, k: int, seed: int, steps: int = 20) -> list[list[float]]:
    """Weighted k-means of a few points: starts by weighted distance, then Lloyd steps."""
    if not len(points):
        return []
    rng = np.random.default_rng(seed)
    centres = points[[int(np.argmax(weights))]]
    while len(centres) < k:
        near = ((points[:, None] - centres[None]) ** 2).sum(axis=2).min(axis=1) * weights
        if near.sum() == 0:
            break
        centres = np.vstack([centres, points[rng.choice(len(points), p=near / near.sum())]])
    for _ in range(steps):
        label = ((points[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        for i in range(len(centres)):
            if (mass := weights[label == i].sum()) > 0:
                centres[i] = weights[label == i] @ points[label == i] / mass
    return centres.tolist()


def cluster_profiles(df: DataFrame, features: Sequence[str], label: str = "cluster") -> DataFrame:
    """Size, share in percent and raw feature means per cluster."""
    profiles = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"), *[F.avg(f).alias(f) for f in features])
    whole = Window.partitionBy(F.lit(1))  # k rows
    return profiles.select(label, "n", (F.col("n") * 100.0 / F.sum("n").over(whole)).alias("pct"), *features)
