import numpy as np
import pytest

from aforo.operators import series as T


def frame(spark, values, name="s", year=2021, month=1):
    rows = []
    for i, v in enumerate(values):
        m = year * 12 + month - 1 + i
        rows.append((name, m // 12, m % 12 + 1, float(v)))
    return spark.createDataFrame(rows, "serie string, nuanio int, nummes int, valor double")


def numpy_decompose(y):
    n = len(y)
    w = np.array([0.5] + [1.0] * 11 + [0.5]) / 12
    trend = np.full(n, np.nan)
    for t in range(6, n - 6):
        trend[t] = w @ y[t - 6 : t + 7]
    det = y - trend
    pos = np.array([np.nanmean(det[p::12]) for p in range(12)])
    pos -= pos.mean()
    return trend, np.resize(pos, n)


@pytest.mark.parametrize("n", [24, 36, 61])
def test_decomposition_matches_numpy(spark, n):
    rng = np.random.default_rng(n)
    y = 100 + np.arange(n) + 10 * np.sin(np.arange(n) * np.pi / 6) + rng.normal(size=n)
    trend, seasonal = numpy_decompose(y)
    got = T.seasonal_decompose(frame(spark, y)).orderBy("t").toPandas()
    np.testing.assert_allclose(got["tendencia"].to_numpy(dtype=float), trend, rtol=1e-10)
    np.testing.assert_allclose(got["estacional"], seasonal, atol=1e-9)
    assert abs(got["estacional"][:12].sum()) < 1e-8
    rest = got["residuo"].to_numpy(dtype=float)
    np.testing.assert_allclose(rest, y - trend - seasonal, atol=1e-9)


def test_short_series(spark):
    df = frame(spark, range(11), "a").union(frame(spark, range(23), "b")).union(frame(spark, range(24), "c"))
    kept = {r["serie"] for r in T.series_select(df).collect()}
    assert kept == {"b", "c"}
    assert {r["serie"] for r in T.seasonal_decompose(df).select("serie").distinct().collect()} == {"c"}
    summary = {r["serie"]: r for r in T.seasonal_summary(df, with_test=False).collect()}
    assert summary["b"]["n_puntos"] == 23 and summary["b"]["mes_max"] is None
    assert summary["c"]["tendencia_inicio"] == pytest.approx(6.0)


def test_position_is_not_the_calendar_month(spark):
    y = [float(i % 12) for i in range(36)]
    pattern = T.monthly_pattern(T.seasonal_decompose(frame(spark, y, month=5)))
    first = pattern.filter("posicion = 1").first()
    assert first["mes"] == 5
    extremes = T.peak_trough_month(pattern).first()
    assert (extremes["mes_max"], extremes["mes_min"]) == (12, 1)


def test_select_by_name(spark):
    df = frame(spark, range(12), "a").union(frame(spark, range(12), "b"))
    assert {r["serie"] for r in T.series_select(df, "b").collect()} == {"b"}


def test_complete_months(spark):
    df = frame(spark, range(1, 15)).filter("not (nuanio = 2021 and nummes = 12)")
    full = T.complete_months(df).orderBy("nuanio", "nummes").collect()
    assert len(full) == 14
    assert [r["valor"] for r in full if (r["nuanio"], r["nummes"]) == (2021, 12)] == [0.0]


@pytest.mark.parametrize(
    "tau,p", [(-2.5425778593129884, 0.10545528636393792), (-4.201051827492745, 0.0006562041141325112)]
)
def test_published_p_values(tau, p):
    assert T.mackinnon_p(tau) == pytest.approx(p, rel=1e-6)


def test_p_value_is_monotone_and_bounded():
    values = [T.mackinnon_p(t) for t in np.linspace(-20, 4, 400)]
    assert all(a <= b + 1e-3 for a, b in zip(values, values[1:]))
    assert values[0] == 0.0 and values[-1] == 1.0


def test_adf_against_direct_regression(spark):
    rng = np.random.default_rng(1)
    y = np.cumsum(rng.normal(size=80))
    row = T.adf_test(frame(spark, y)).first()
    lag = row["adf_lag"]
    dy = np.diff(y)
    x = np.column_stack(
        [np.ones(len(dy) - lag), y[lag:-1], *[dy[lag - j : len(dy) - j] for j in range(1, lag + 1)]]
    )
    target = dy[lag:]
    beta, *_ = np.linalg.lstsq(x, target, rcond=None)
    e = target - x @ beta
    se = np.sqrt(e @ e / (len(target) - x.shape[1]) * np.linalg.inv(x.T @ x)[1, 1])
    assert row["adf_statistic"] == pytest.approx(beta[1] / se, rel=1e-8)
    assert 0 <= row["adf_pvalue"] <= 1


def test_adf_tells_noise_from_a_walk(spark):
    rng = np.random.default_rng(3)
    noise, walk = rng.normal(size=120), np.cumsum(rng.normal(size=120)) + np.arange(120)
    df = frame(spark, noise, "noise").union(frame(spark, walk, "walk")).union(frame(spark, [5.0] * 30, "flat"))
    got = {r["serie"]: r for r in T.adf_test(df).collect()}
    assert got["noise"]["es_estacionaria"] is True
    assert got["walk"]["es_estacionaria"] is False
    assert got["flat"]["adf_statistic"] is None


def test_many_series_share_one_exchange(spark):
    df = frame(spark, range(36)).repartition(4)
    plan = T.seasonal_decompose(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_fixed_lag_statistic_is_that_of_the_regression(spark):
    rng = np.random.default_rng(6)
    walks = {"walk": np.cumsum(rng.normal(size=60)), "noise": rng.normal(size=60), "short": rng.normal(size=5), "flat": np.ones(30)}
    rows = [(name, 2000 + i // 12, i % 12 + 1, float(v)) for name, y in walks.items() for i, v in enumerate(y)]
    df = spark.createDataFrame(rows, "serie string, nuanio int, nummes int, valor double")
    got = {r["serie"]: r for r in T.adf_fixed_lag(df).collect()}
    for name in ("walk", "noise"):
        tau, _ = T._adf_regression(walks[name], 1, 1)
        assert got[name]["adf_statistic"] == pytest.approx(tau, rel=1e-9) and got[name]["n"] == 58
    # three differences are as many as the terms; a flat series has no variance
    assert got["short"]["adf_statistic"] is None and got["flat"]["adf_statistic"] is None
