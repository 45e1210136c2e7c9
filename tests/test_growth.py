"""What larger tables must not multiply: scans, buffers of each group, streaming batches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from aforo.operators import quantiles as Q
from aforo.operators import features as FT
from aforo.operators.features import features_unit
from aforo.streaming import incremental as INC
from catalog import queries as C

PROBS = {"a": 0.0, "b": 0.3, "c": 0.5, "d": 1.0}


@pytest.fixture(scope="module")
def groups(spark):
    rng = np.random.default_rng(7)
    rows = [(None if k == 3 else k, None if v > 80 else float(v) / 7, int(v) % 4 or None) for k, n in enumerate((1, 2, 300, 41, 5)) for v in rng.integers(0, 90, n)]
    return spark.createDataFrame([*rows, (9, None, None)], "k int, v double, y int")


def table(df, **how):
    rows = Q.group_quantiles(df, ["k"], "v", PROBS, [F.count("*").alias("n")], distinct={"years": "y"}, **how)
    return sorted(map(tuple, rows.select("k", "n", "years", *PROBS).collect()), key=str)


def same(got, want):
    assert [r[:3] for r in got] == [r[:3] for r in want]
    for a, b in zip(got, want, strict=True):
        assert a[3:] == pytest.approx(b[3:], rel=1e-12, nan_ok=True) if b[3] is not None else a[3:] == b[3:]


@pytest.mark.parametrize("method", ["linear", "nearest"])
@pytest.mark.parametrize("hot_rows", [10**6, 100, 1])
def test_units_on_all_paths_equal_the_built_in_percentile(groups, method, hot_rows):
    same(table(groups, method=method, hot_rows=hot_rows, small_groups=True), table(groups, method=method, hot_rows=None))


@pytest.mark.parametrize("method", ["linear", "nearest"])
def test_many_hot_groups_need_no_sketches(groups, method, monkeypatch):
    monkeypatch.setattr(Q, "MAX_BROADCAST_GROUPS", 2)
    monkeypatch.setattr(Q, "_sketch", None)
    same(table(groups, method=method, hot_rows=1), table(groups, method=method, hot_rows=None))


def test_units_keep_no_buffer_for_each_group_and_read_records_once(spark, bills):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    df = bills(*[dict(codudu=i % 5, volfac=float(i)) for i in range(20)])
    units = features_unit(df.mapInArrow(count, df.schema))
    plan = units._jdf.queryExecution().toString()
    assert "percentile" not in plan and "collect_set" not in plan
    assert units.count() == 5 and seen.value == 20


def test_scaler_takes_many_files_a_batch(spark, monkeypatch):
    seen, real = [], INC.stream_table
    monkeypatch.setattr(INC, "stream_table", lambda *a, **k: seen.append(k.get("files_per_batch", 1)) or real(*a, **k))
    C.QUERIES["standardise_incremental"](spark, "/root/testdata/sf0.001").collect()
    assert seen == [C.SMALL_FILES]


def test_distinct_ids_are_dealt_by_rows(bills, monkeypatch):
    """Districts read records once; no task collects ids of much more than its share, one id or not."""
    monkeypatch.setattr(FT, "ROWS_PER_DISTINCT", 50)
    seen, real = [], FT._dealt
    monkeypatch.setattr(FT, "_dealt", lambda *a: seen.append(real(*a)) or seen[0])
    df = bills(*[dict(codudu=i % 3, codcon=1, volfac=float(i)) for i in range(400)])
    row = FT.features_district_month(df).first()
    assert (row.num_registros, row.num_unidades, row.num_conexiones) == (400, 3, 1)
    assert all("/aforo/" in f for f in seen[0].inputFiles())
    sizes = seen[0].groupBy(F.spark_partition_id()).count().collect()
    assert seen[0].rdd.getNumPartitions() == 8 and max(r["count"] for r in sizes) < 200
