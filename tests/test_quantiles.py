import numpy as np
import pytest
from pyspark.sql import functions as F

from aforo.functions.hashing import key_hash
from aforo.operators import quantiles as Q
from aforo.operators.selection import smallest

PROBS = {"p01": 0.01, "p25": 0.25, "p50": 0.5, "p95": 0.95, "p100": 1.0, "p0": 0.0}


@pytest.fixture(scope="module")
def skewed(spark):
    """One key with a third of the rows, long tails, many ties."""
    i = F.col("id")
    h = (i * 48271) % 2147483647
    return spark.range(30_000).select(
        F.when(i % 3 == 0, 0).otherwise(i % 4 + 1).cast("int").alias("k"),
        F.when(h % 5 == 0, F.lit(1.5)).otherwise(F.exp((h % 1000) / 100.0)).alias("v"),
    )


def expected(df, method="linear"):
    pdf = df.toPandas()
    return {
        k: [float(np.quantile(g, p, method=method)) for p in PROBS.values()] for k, g in pdf.groupby("k")["v"]
    }


@pytest.mark.parametrize("stop_rows", [10, 1_000, 10**9])
def test_large_group_path_is_exact(skewed, stop_rows):
    want = expected(skewed)
    got = Q.select_quantiles(skewed, ["k"], "v", PROBS, stop_rows=stop_rows).collect()
    assert len(got) == len(want)
    for r in got:
        assert [r[n] for n in PROBS] == pytest.approx(want[r["k"]], rel=1e-12)


def test_split_into_hot_and_cold(skewed):
    want = expected(skewed)
    got = Q.group_quantiles(skewed, ["k"], "v", PROBS, [F.count("*").alias("n")], hot_rows=8_000)
    rows = got.collect()
    assert sum(r["n"] for r in rows) == 30_000
    for r in rows:
        assert [r[n] for n in PROBS] == pytest.approx(want[r["k"]], rel=1e-12)


def test_whole_table_as_one_group(skewed):
    v = skewed.toPandas()["v"]
    got = Q.group_quantiles(skewed.select("v"), [], "v", PROBS, hot_rows=100).first()
    assert [got[n] for n in PROBS] == pytest.approx([np.quantile(v, p) for p in PROBS.values()], rel=1e-12)


def test_nearest_on_both_paths(skewed):
    plain = {r["k"]: r for r in Q.group_quantiles(skewed, ["k"], "v", PROBS, method="nearest").collect()}
    hot = Q.group_quantiles(skewed, ["k"], "v", PROBS, method="nearest", hot_rows=1).collect()
    for r in hot:
        assert [r[n] for n in PROBS] == [plain[r["k"]][n] for n in PROBS]


def test_a_bracket_that_misses_is_widened(skewed, monkeypatch):
    """Even with useless brackets the counts keep the answer exact."""
    good = Q._brackets
    monkeypatch.setattr(
        Q, "_brackets", lambda located, keys: good(located, keys).withColumns({"_a": F.lit(-2.0), "_z": F.lit(-1.0)})
    )
    want = expected(skewed)
    for r in Q.select_quantiles(skewed, ["k"], "v", PROBS, stop_rows=10**9).collect():
        assert [r[n] for n in PROBS] == pytest.approx(want[r["k"]], rel=1e-12)


def test_constant_and_null_values(spark):
    df = spark.createDataFrame([(1, 2.0)] * 500 + [(1, None)] * 5 + [(2, 7.0)], "k int, v double")
    got = {r["k"]: r["p50"] for r in Q.select_quantiles(df, ["k"], "v", {"p50": 0.5}, stop_rows=1).collect()}
    assert got == {1: 2.0, 2: 7.0}


def test_no_hot_group_found(skewed):
    assert Q.hot_groups(skewed, ["k"], 10**6) == []
    zero = skewed.filter("k = 0").select(F.xxhash64("k")).first()[0]
    assert Q.hot_groups(skewed, ["k"], 9_000) == [zero]
    assert Q.hot_groups(skewed, [], 9_000) and not Q.hot_groups(skewed, [], 10**6)


@pytest.mark.parametrize("n", [0, 1, 7, 1_000, 5_000, 9_999])
def test_smallest_is_exact(spark, n):
    df = spark.range(5_000).select("id", ((F.col("id") * 7) % 100).alias("h"))
    got = sorted(r["id"] for r in smallest(df, "h", n, ["id"]).collect())
    order = sorted(range(5_000), key=lambda i: (i * 7 % 100, i))
    assert got == sorted(order[:n])


def test_smallest_of_equal_hashes(spark):
    """One hash for all rows: signed and null ties in order, texts by their hash, equal rows together."""
    rows = [(5, v, t) for v in (-(2**63), -1, None, 0, 3, 2**40, 2**63 - 1) for t in ("a", "b")]
    df = spark.createDataFrame(rows + rows[:1], "h long, v long, t string")
    by_number = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0))
    for n in (2, 4, 8, 12):
        got = [r["v"] for r in smallest(df.dropDuplicates(), "h", n, ["v"]).collect()]
        assert sorted(got, key=str) == sorted((r[1] for r in by_number[:n]), key=str)
    assert smallest(df, "h", 1, ["v", "t"]).count() == 1
    whole = [smallest(df, "h", n, ["t", "v"]).count() for n in range(1, 17)]
    # the repeated row comes twice or not at all
    assert whole[-1] == 15 and sorted(whole[:15]) == whole[:15] and len(set(whole[:15])) == 14


def test_key_hash_is_the_same_for_a_known_type(spark):
    df = spark.createDataFrame([(1, "1"), (-7, "-7"), (None, None), (2**40, str(2**40))], "a long, b string")
    rows = df.select(key_hash(["a"], 1, df).alias("p"), key_hash(["a"], 1).alias("q"), key_hash(["b"], 1, df).alias("r")).collect()
    assert all(x.p == x.q == x.r for x in rows)
    assert "as string" not in df.select(key_hash(["a"], 1, df))._jdf.queryExecution().optimizedPlan().toString()


def counted(spark, df):
    """The rows of ``df`` and a counter of how many of them were read."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    return df.mapInArrow(count, df.schema), seen


@pytest.mark.parametrize("hot_rows", [1, 9_000])
def test_three_scans_with_hot_groups(spark, skewed, hot_rows):
    n = skewed.count()
    rows, seen = counted(spark, skewed)
    got = Q.group_quantiles(rows, ["k"], "v", PROBS, [F.count("v").alias("n"), F.sum("v").alias("s")], hot_rows=hot_rows)
    got = sorted(map(tuple, got.collect()))
    assert seen.value == 3 * n
    want = Q.group_quantiles(skewed, ["k"], "v", PROBS, [F.count("v").alias("n"), F.sum("v").alias("s")], hot_rows=None)
    for a, b in zip(got, sorted(map(tuple, want.collect())), strict=True):
        assert a == pytest.approx(b, rel=1e-12)


@pytest.mark.parametrize("method", ["linear", "nearest"])
def test_ranking_by_ranges_is_exact(spark, method):
    """Many distinct values in each bracket, dealt over partitions."""
    rng = np.random.default_rng(4)
    rows = [(k, float(v)) for k, n in ((1, 4000), (2, 700), (None, 900)) for v in rng.integers(0, 2500, n)]
    df = spark.createDataFrame(rows, "k int, v double")
    probs = {"a": 0.1, "b": 0.5, "c": 0.999}
    one, other = (
        sorted(map(tuple, Q.select_quantiles(df, ["k"], "v", probs, method, stop_rows=n).collect()), key=str) for n in (1, 10**6)
    )
    plain = sorted(map(tuple, Q.group_quantiles(df, ["k"], "v", probs, method=method, hot_rows=None).collect()), key=str)
    assert one == other and [r[0] for r in one] == [r[0] for r in plain]
    np.testing.assert_allclose([r[1:] for r in one], [r[1:] for r in plain], rtol=1e-12)
