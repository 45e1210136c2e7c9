import numpy as np
import pytest
from pyspark.sql import functions as F

from aforo.operators import regression as G

N = 600


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(N):
        unit = int(i % 90)
        rows.append(
            (
                "1to2" if i % 3 else "2to1", unit // 3, unit, int(rng.integers(-3, 4)), 2021, int(rng.integers(1, 13)),
                int(rng.integers(1, 4)), str(rng.choice(["101", "102", "103"])), int(rng.integers(1, 3)),
                str(rng.choice(["A", "L"])), float(rng.uniform(1, 24)), float(rng.integers(1, 8)),
                float(rng.normal() + unit % 5),
            )
        )
    return spark.createDataFrame(
        rows,
        "event_type string, codcon long, codudu long, t_rel int, nuanio int, nummes int, coddis int, "
        "codcat string, codtis int, codmof string, hoxdia double, diasem double, volfac double",
    )


def reference_fit(x, y, clusters):
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    e = y - x @ beta
    bread = np.linalg.inv(x.T @ x)
    s = np.array([(x[clusters == c] * e[clusters == c, None]).sum(axis=0) for c in np.unique(clusters)])
    g, n, k = len(s), len(y), x.shape[1]
    v = g / (g - 1) * (n - 1) / (n - k) * bread @ (s.T @ s) @ bread
    return beta, np.sqrt(np.diag(v)), g, 1 - (e @ e) / ((y - y.mean()) @ (y - y.mean()))


def full_design(pdf):
    names, cols = ["intercept"], [np.ones(len(pdf))]
    for t in sorted(pdf["t_rel"].unique()):
        if t != -1:
            names.append(f"t_rel__{t}")
            cols.append((pdf["t_rel"] == t).astype(float))
    names += ["mes_abs", "hoxdia", "diasem"]
    cols += [pdf["nuanio"] * 12.0 + pdf["nummes"], pdf["hoxdia"], pdf["diasem"]]
    for c in ("coddis", "codcat", "codtis", "codmof"):
        for v in sorted(pdf[c].dropna().unique())[1:]:
            names.append(f"{c}__{v}")
            cols.append((pdf[c] == v).astype(float))
    return names, np.column_stack(cols)


@pytest.mark.parametrize("kind", ["1to2", "2to1"])
def test_event_study_matches_matrix_algebra(data, kind):
    pdf = data.toPandas()
    pdf = pdf[pdf["event_type"] == kind]
    names, x = full_design(pdf)
    beta, se, g, r2 = reference_fit(x, pdf["volfac"].to_numpy(), (pdf["codcon"] * 1000 + pdf["codudu"]).to_numpy())
    got = {r["term"]: r for r in G.event_study(data, [kind]).collect()}
    assert set(got) == set(names)
    for name, b, s in zip(names, beta, se):
        assert got[name]["coef"] == pytest.approx(b, rel=1e-6, abs=1e-7)
        assert got[name]["std_error"] == pytest.approx(s, rel=1e-6)
    assert got["intercept"]["n_clusters"] == g
    assert got["intercept"]["r2"] == pytest.approx(r2)
    assert got["intercept"]["rank"] == len(names)


def test_repartitioning_does_not_matter(data):
    a = G.event_study(data.coalesce(1), ["1to2"]).toPandas()
    b = G.event_study(data.repartition(9), ["1to2"]).toPandas()
    np.testing.assert_allclose(a["coef"], b["coef"], rtol=1e-8, atol=1e-10)
    np.testing.assert_allclose(a["std_error"], b["std_error"], rtol=1e-8)


def test_centring_leaves_slopes_alone(data):
    month = F.col("nuanio") * 12 + F.col("nummes")
    fits = []
    for centre in (0.0, 24258.0):
        terms = [G.intercept(), G.numeric(month, "mes_abs", centre), G.numeric("hoxdia", "hoxdia")]
        fits.append({r["term"]: r["coef"] for r in G.ols(data, "volfac", terms).collect()})
    for term in fits[0]:
        assert fits[0][term] == pytest.approx(fits[1][term], rel=1e-5, abs=1e-6)


def test_missing_covariate_drops_the_row_and_missing_level_does_not(spark, data):
    hole = data.limit(1).withColumn("hoxdia", F.lit(None).cast("double"))
    blank = data.limit(1).withColumn("codcat", F.lit(None).cast("string"))
    n = data.filter("event_type = '1to2'").count()
    kind = data.first()["event_type"]
    base = data.filter(F.col("event_type") == kind).count()
    got = G.event_study(data.unionByName(hole).unionByName(blank), [kind]).first()
    assert got["n_obs"] == base + 1
    assert n > 0


def test_unknown_and_missing_levels_are_all_zero(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "c string")
    rows = G.dummy_encode(df, ["c"], {"c": ["a", "b"]}).collect()
    assert [r["c__b"] for r in rows] == [0.0, 1.0, 0.0, 0.0]
    assert G.dummy_terms(["c"], {"c": ["a"]}) == []


def test_collinear_design_reports_its_rank(data):
    terms = [G.intercept(), G.numeric("hoxdia", "h"), G.numeric(F.col("hoxdia") * 2, "h2")]
    fit = G.ols_normal_equations(data, "volfac", terms)
    assert fit.rank == 2
    pdf = data.toPandas()
    slope = np.polyfit(pdf["hoxdia"], pdf["volfac"], 1)[0]
    assert fit.beta[1] + 2 * fit.beta[2] == pytest.approx(slope, rel=1e-6)


def test_covariance_is_symmetric_and_not_negative(data):
    terms = [G.intercept(), G.numeric("hoxdia", "h"), *G.dummy_terms(["codcat"], {"codcat": ["101", "102", "103"]})]
    fit = G.cluster_robust(data, G.ols_normal_equations(data, "volfac", terms))
    np.testing.assert_allclose(fit.covariance, fit.covariance.T, atol=1e-14)
    assert np.linalg.eigvalsh(fit.covariance).min() > -1e-12


def test_no_baseline_skips_the_type(data):
    assert G.event_study(data.filter("t_rel > 0")).count() == 0


def test_one_hot_cluster(data):
    """A cluster with a third of the rows changes nothing but the grouping."""
    hot = data.withColumns({c: F.when(F.col("codudu") % 3 == 0, 0).otherwise(F.col(c)) for c in ("codcon", "codudu")})
    pdf = hot.toPandas()
    x = np.column_stack([np.ones(len(pdf)), pdf["hoxdia"]])
    beta, se, g, _ = reference_fit(x, pdf["volfac"].to_numpy(), (pdf["codcon"] * 1000 + pdf["codudu"]).to_numpy())
    got = {r["term"]: r for r in G.ols(hot, "volfac", [G.intercept(), G.numeric("hoxdia", "h")]).collect()}
    assert got["h"]["std_error"] == pytest.approx(se[1], rel=1e-8)
    assert got["h"]["n_clusters"] == g


def test_interval(data):
    rows = G.coef_interval(G.ols(data, "volfac", [G.intercept()])).collect()
    r = rows[0]
    assert r["ci_high"] - r["ci_low"] == pytest.approx(2 * 1.96 * r["std_error"])


def test_pooled_cells_give_the_same_fit(data):
    """Pooling rows with equal regressors changes neither coefficients nor fit."""
    terms = [G.intercept(), G.numeric("diasem", "d", 4.0), *G.dummy_terms(["codcat"], {"codcat": ["101", "102", "103"]})]
    assert G.design_statistics(data, [], [], ["diasem", "codcat"])[2]
    assert not G.design_statistics(data, [], [], ["hoxdia"])[2]
    plain = G.ols(data, "volfac", terms).toPandas()
    pooled = G.ols(data, "volfac", terms, cells=["diasem", "codcat"]).toPandas()
    for c in ("coef", "std_error", "r2", "n_obs"):
        np.testing.assert_allclose(plain[c].astype(float), pooled[c].astype(float), rtol=1e-9)


@pytest.mark.parametrize("batch", ["7", "10000"])
def test_clusters_over_many_batches(spark, batch):
    """Long clusters, null and text keys: dealt out or not, and whatever the batch size, the same errors."""
    rng = np.random.default_rng(9)
    rows = [
        (None if c == 3 else f"u{c}", c % 2, str(rng.choice(["a", "b", "c"])), float(rng.normal()), float(rng.normal()))
        for c, n in enumerate([1, 2, 150, 40, 1, 80, 3, 30]) for _ in range(n)
    ]
    df = spark.createDataFrame(rows, "u string, v int, level string, x double, y double").repartition(3)
    terms = [G.intercept(), G.numeric("x", "x", 0.5), *G.dummy_terms(["level"], {"level": ["a", "b", "c"]})]
    pdf = df.toPandas()
    x = np.column_stack([np.ones(len(pdf)), pdf["x"], pdf["level"] == "b", pdf["level"] == "c"]).astype(float)
    beta, se, g, r2 = reference_fit(x, pdf["y"].to_numpy(), (pdf["u"].fillna("?") + pdf["v"].astype(str)).to_numpy())
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        for hot in (None, []):
            got = {r["term"]: r for r in G.ols(df, "y", terms, ["u", "v"], hot=hot).collect()}
            for name, b, s in zip(["intercept", "x", "level__b", "level__c"], beta, se, strict=True):
                assert got[name]["coef"] == pytest.approx(b, rel=1e-9)
                assert got[name]["std_error"] == pytest.approx(s, rel=1e-9)
            assert (got["x"]["n_clusters"], got["x"]["r2"]) == (g, pytest.approx(r2))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_statistics_come_from_one_pass(spark):
    rows = [(i % 5, None if i % 4 == 0 else f"k{i % 4}", float(i), 0 if i < 300 else i) for i in range(900)]
    df = spark.createDataFrame(rows, "a int, b string, x double, unit int")
    got = G.design_statistics(df, ["a", "b"], ["x"], ["a", "b"], ["unit"])
    assert got.levels == {"a": [0, 1, 2, 3, 4], "b": ["k1", "k2", "k3"]}
    assert got.means == [449.5] and got.pool
    hot = df.filter("unit = 0").select(G.sparse.cluster_hash(["unit"])).first()[0]
    assert got.hot == [hot]


def test_a_fit_reads_its_rows_three_times(spark, data):
    from aforo.session import scratch_path

    path = scratch_path(spark, "fit-rows")
    data.coalesce(1).write.parquet(path)
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = spark.read.parquet(path)
    counted = rows.mapInArrow(count, rows.schema)
    G.event_study(counted, ["1to2"]).collect()
    assert seen.value == 3 * N
