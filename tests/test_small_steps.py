"""Many small files in one streaming batch are steps of their own."""

import os
from pathlib import Path

import pytest

from aforo.session import scratch_path
from aforo.streaming import incremental as INC

SCALES = {"a": (0.5, 2.0), "b": (0.0, 1.0)}


@pytest.fixture(scope="module")
def files(spark):
    path = scratch_path(spark, "small-files")
    rows = spark.range(0, 300, 1, 3).selectExpr(
        "id", "case when id % 50 = 7 then null else sin(id * 1.7) * 3 end as a", "cos(id * 0.9) + id / 100 as b"
    )
    rows.write.option("maxRecordsPerFile", 20).parquet(path)
    # files of one instant come in any order
    for i, file in enumerate(sorted(Path(path).glob("*.parquet"))):
        os.utime(file, (1_700_000_000 + i, 1_700_000_000 + i))
    return path, rows.schema


def centres(spark, files, **options):
    path, schema = files
    stream = INC.stream_table(spark, path, schema, **options)
    got = INC.minibatch_kmeans(
        stream, ["a", "b"], SCALES, [[-1.0, 0.0], [1.0, 0.0], [50.0, 50.0]], scratch_path(spark, "s"), scratch_path(spark, "c")
    )
    return got.orderBy("cluster").collect()


@pytest.mark.parametrize("per_batch", [4, 100])
def test_steps_move_centres_as_batches_of_one_file(spark, files, per_batch):
    want = centres(spark, files)
    got = centres(spark, files, files_per_batch=per_batch, steps=True)
    for g, w in zip(got, want, strict=True):
        assert (g["cluster"], g["weight"]) == (w["cluster"], w["weight"])
        assert g["centre"] == pytest.approx(w["centre"], rel=1e-9)
    whole = centres(spark, files, files_per_batch=100)
    assert any(g["centre"] != pytest.approx(w["centre"], rel=1e-6) for g, w in zip(got, whole))
