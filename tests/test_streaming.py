import numpy as np
import pytest

from aforo.operators.encode import scaling
from aforo.session import scratch_path
from aforo.streaming import incremental as INC


@pytest.fixture(scope="module")
def source(spark):
    rng = np.random.default_rng(2)
    rows = [(i, float(rng.normal(50, 9)), float(rng.exponential())) for i in range(400)]
    rows.append((400, None, 1.0))
    path = scratch_path(spark, "stream-source")
    df = spark.createDataFrame(rows, "id long, a double, b double")
    df.coalesce(1).write.option("maxRecordsPerFile", 60).parquet(path)
    return path, spark.read.parquet(path)


def test_running_scaler_equals_the_batch_scaler(spark, source):
    path, df = source
    state, check = scratch_path(spark, "s"), scratch_path(spark, "c")
    stream = INC.stream_table(spark, path, df.schema)
    got = {r["feature"]: r for r in INC.standardise_incremental(stream, ["a", "b"], state, check).collect()}
    want = scaling(df.dropna(), ["a", "b"])
    for f in ("a", "b"):
        assert got[f]["n"] == 400
        assert (got[f]["mean"], got[f]["std"]) == pytest.approx(want[f], rel=1e-10)


def test_replayed_batch_counts_once(spark, source):
    """Running batch 1 a second time, as after a failure, leaves the same state."""
    path, df = source
    state = scratch_path(spark, "s")
    parts = [df.filter("id < 100"), df.filter("id >= 100 and id < 300")]

    def update(batch, batch_id):
        stats = INC.batch_moments(batch.dropna(), ["a"])
        if batch_id > 0:
            stats = stats.unionByName(INC._state(spark, state, batch_id - 1, INC.SCALER_SCHEMA))
        INC._store(INC.merge_moments(stats), state, batch_id)

    update(parts[0], 0)
    update(parts[1], 1)
    once = INC.latest_state(spark, state, INC.SCALER_SCHEMA).first()
    update(parts[1], 1)
    assert INC.latest_state(spark, state, INC.SCALER_SCHEMA).first() == once
    assert once["n"] == 300


def test_centroids_follow_the_count_weighted_update(spark, source):
    path, df = source
    rows = df.dropna()
    scales = scaling(rows, ["a", "b"])
    start = [[-1.0, 0.0], [1.0, 0.0]]
    state, check = scratch_path(spark, "s"), scratch_path(spark, "c")
    stream = INC.stream_table(spark, path, df.schema, files_per_batch=100)
    got = INC.minibatch_kmeans(stream, ["a", "b"], scales, start, state, check).orderBy("cluster").collect()
    x = np.array([[(r["a"] - scales["a"][0]) / scales["a"][1], (r["b"] - scales["b"][0]) / scales["b"][1]]
                  for r in rows.collect()])
    label = ((x[:, None] - np.array(start)[None]) ** 2).sum(axis=2).argmin(axis=1)
    for k in (0, 1):
        assert got[k]["weight"] == (label == k).sum()
        np.testing.assert_allclose(got[k]["centre"], x[label == k].mean(axis=0), rtol=1e-9)


def test_weights_add_up_over_batches(spark, source):
    path, df = source
    scales = scaling(df.dropna(), ["a", "b"])
    stream = INC.stream_table(spark, path, df.schema)
    got = INC.minibatch_kmeans(
        stream, ["a", "b"], scales, [[-1.0, 0.0], [1.0, 0.0]], scratch_path(spark, "s"), scratch_path(spark, "c")
    )
    assert sum(r["weight"] for r in got.collect()) == 400


def test_only_the_last_two_states_stay(spark, source):
    path, df = source
    state = scratch_path(spark, "s")
    stream = INC.stream_table(spark, path, df.schema)
    INC.standardise_incremental(stream, ["a", "b"], state, scratch_path(spark, "c")).collect()
    batches = sorted(r[0] for r in spark.read.parquet(state).select("batch").distinct().collect())
    n = len(df.inputFiles())
    assert n > 3 and batches == [n - 2, n - 1]


def test_scaler_state_scales_as_the_batch_scaler(spark, source):
    path, df = source
    stream = INC.stream_table(spark, path, df.schema)
    scaler = INC.standardise_incremental(stream, ["a", "b"], scratch_path(spark, "s"), scratch_path(spark, "c"))
    want = scaling(df.dropna(), ["a", "b"])
    got = INC.scales_of(scaler, ["a", "b", "none"])
    assert got["none"] == (0.0, 1.0)
    for f in ("a", "b"):
        assert got[f] == pytest.approx(want[f], rel=1e-10)


def test_a_stopped_stream_goes_on_where_it_was(spark, source):
    """A second run over more files adds only these."""
    path, df = source
    folder = scratch_path(spark, "growing")
    state, check = scratch_path(spark, "s"), scratch_path(spark, "c")
    for part in (df.filter("id < 150"), df.filter("id >= 150")):
        part.coalesce(1).write.mode("append").parquet(folder)
        stream = INC.stream_table(spark, folder, df.schema)
        got = INC.standardise_incremental(stream, ["a"], state, check).first()
    assert got["n"] == 400
    assert INC.standardise_incremental(INC.stream_table(spark, folder, df.schema), ["a"], state, check).first() == got
