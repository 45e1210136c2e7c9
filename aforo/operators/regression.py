"""Least squares with cluster-robust errors on designs of dummies and covariates.

Rows stay on executors. Each task reduces its rows to one k x k product matrix
(:mod:`aforo.operators.sparse`), these are summed by entry, and only that matrix
reaches the driver. Cluster scores are summed by the tasks that hold the clusters
and reduced the same way. Nothing on the driver grows with the number of rows or
clusters. A fit reads its rows three times: statistics, products, scores.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aforo import schema as S
from aforo.functions.measures import month_index
from aforo.operators import sparse

CLUSTER = ["codcon", "codudu"]
MAX_TERMS = 2_000
CELL_GAIN = 10
#: Values that the levels' sketch tells apart exactly, and clusters that may be hot.
TRACKED = 5 * MAX_TERMS
HOT_CLUSTERS = 64
Z_95 = 1.96
TREND = "mes_abs"

COEFFICIENT_SCHEMA = (
    "term string, coef double, std_error double, t_stat double, "
    "n_obs long, n_clusters long, r2 double, rank int"
)


@dataclass(frozen=True)
class Term:
    """One regressor: a name, its column, and the value it is centred at.

    A dummy also names its source column and level, a constant says so.
    """

    name: str
    column: Column = field(compare=False)
    centre: float = 0.0
    source: str | None = None
    level: object = None
    constant: bool = False

    def centred(self) -> Column:
        return self.column - F.lit(self.centre) if self.centre else self.column


def intercept() -> Term:
    return Term("intercept", F.lit(1.0), constant=True)


def indicator(column: str, level, name: str | None = None) -> Term:
    """1 where the column equals the level, 0 elsewhere and for a missing value."""
    value = F.coalesce((F.col(column) == F.lit(level)).cast("double"), F.lit(0.0))
    return Term(name or f"{column}__{level}", value, source=column, level=level)


def numeric(column: str | Column, name: str, centre: float = 0.0) -> Term:
    c = F.col(column) if isinstance(column, str) else column
    return Term(name, c.cast("double"), centre)


def dummy_terms(columns: Sequence[str], levels: dict[str, list]) -> list[Term]:
    """Drop-first dummies of the sorted levels; a column with one level adds none."""
    return [indicator(c, v) for c in columns for v in levels.get(c, [])[1:]]


def dummy_encode(df: DataFrame, columns: Sequence[str], levels: dict[str, list] | None = None) -> DataFrame:
    """Add the drop-first dummy columns ``col__level``."""
    levels = levels or design_statistics(df, columns, [])[0]
    return df.withColumns({t.name: t.column for t in dummy_terms(columns, levels)})


def design_matrix(df: DataFrame, terms: Sequence[Term], keep: Sequence[str] = ()) -> DataFrame:
    """The regressors as named double columns."""
    return df.select(*keep, *[t.centred().alias(t.name) for t in terms])


def usable(df: DataFrame, outcome: Column, terms: Sequence[Term]) -> DataFrame:
    """Rows with an outcome and every number of the design; the fit and its scores read the same ones."""
    complete = outcome.isNotNull()
    for t in terms:
        if t.source is None and not t.constant:  # a dummy is never null
            complete = complete & t.column.isNotNull()
    return df.filter(complete)


class Statistics(NamedTuple):
    levels: dict[str, list]
    means: list[float]
    pool: bool
    #: hashes of clusters with at least 1 / HOT_CLUSTERS of the rows
    hot: list[int]


def design_statistics(
    df: DataFrame,
    categorical: Sequence[str],
    numerics: Sequence[str | Column],
    cells: Sequence[str] = (),
    cluster: Sequence[str] = (),
) -> Statistics:
    """What a design needs to know about its rows, in one pass.

    Sorted levels of the categorical columns, means of the numeric ones, whether
    the distinct combinations of ``cells`` are far fewer than the rows, and the
    clusters that hold a large share of them. Levels and clusters come from
    frequent-items sketches of bounded size. A sketch that never had to forget a
    value counted every row, so its values are all there are; an id column does
    not get that far and is refused.
    """
    if not categorical and not numerics and not cells and not cluster:
        return Statistics({}, [], False, [])
    top = lambda c, k, tracked: F.call_function("approx_top_k", c, F.lit(k), F.lit(tracked))
    cols = [top(F.col(c), MAX_TERMS + 2, TRACKED).alias(f"l{i}") for i, c in enumerate(categorical)]
    cols += [F.avg(c).alias(f"m{i}") for i, c in enumerate(numerics)]
    distinct = F.approx_count_distinct(F.struct(*cells)) if cells else F.lit(0)
    frequent = top(sparse.cluster_hash(cluster), HOT_CLUSTERS, 64 * HOT_CLUSTERS) if cluster else F.lit(None)
    row = df.agg(*cols, F.count(F.lit(1)).alias("n"), distinct.alias("d"), frequent.alias("h")).first()
    levels = {}
    for i, c in enumerate(categorical):
        if sum(x["count"] for x in row[f"l{i}"]) < row["n"]:
            raise ValueError("too many levels for a dense design; pass fewer categorical columns")
        levels[c] = sorted(x["item"] for x in row[f"l{i}"] if x["item"] is not None)
    if sum(len(v) for v in levels.values()) > MAX_TERMS:
        raise ValueError("too many levels for a dense design; pass fewer categorical columns")
    means = [float(row[f"m{i}"] or 0.0) for i in range(len(numerics))]
    hot = [x["item"] for x in row["h"] or [] if x["count"] * HOT_CLUSTERS >= row["n"]]
    return Statistics(levels, means, bool(cells) and row["d"] * CELL_GAIN < row["n"], hot)


def product_matrix(df: DataFrame, vector: Sequence[Column]) -> DataFrame:
    """Entries (i, j, value), i <= j, of the sum over rows of v v'."""
    k = len(vector)
    if k > MAX_TERMS:
        raise ValueError(f"{k} terms exceed {MAX_TERMS}")
    upper_i, upper_j = np.triu_indices(k)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        seen = False
        for batch in batches:
            if batch.num_rows:
                seen = True
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
                total += x.T @ x
        if seen:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(upper_i.astype(np.int32)),
                    pa.array(upper_j.astype(np.int32)),
                    pa.array(total[upper_i, upper_j]),
                ],
                names=["i", "j", "v"],
            )

    rows = df.select(F.array(*[c.cast("double") for c in vector]).alias("x"))
    parts = rows.mapInArrow(partial, "i int, j int, v double")
    return parts.groupBy("i", "j").agg(F.sum("v").alias("value"))


@dataclass
class Fit:
    """A least-squares fit in centred terms."""

    terms: list[Term]
    outcome: Column
    beta: np.ndarray
    bread: np.ndarray
    rank: int
    n: int
    sst: float
    sse: float | None = None
    covariance: np.ndarray | None = None
    n_clusters: int | None = None

    @property
    def r2(self) -> float | None:
        return 1.0 - self.sse / self.sst if self.sse is not None and self.sst > 0 else None

    def residual(self) -> Column:
        predicted = F.lit(0.0)
        for b, t in zip(self.beta, self.terms):
            predicted = predicted + F.lit(float(b)) * t.centred()
        return self.outcome - predicted

    def _uncentre(self) -> np.ndarray:
        """Maps centred to original coefficients: only the intercept moves."""
        t = np.eye(len(self.terms))
        if self.terms[0].name == "intercept":
            t[0, 1:] = [-x.centre for x in self.terms[1:]]
        return t

    def coefficients(self) -> list[tuple]:
        t = self._uncentre()
        beta = t @ self.beta
        if self.covariance is None:
            se = np.full(len(beta), np.nan)
        else:
            se = np.sqrt(np.maximum(np.diag(t @ self.covariance @ t.T), 0.0))
        rows = []
        for term, b, s in zip(self.terms, beta, se):
            known = np.isfinite(s)
            rows.append(
                (
                    term.name, float(b), float(s) if known else None,
                    float(b / s) if known and s > 0 else None,
                    self.n, self.n_clusters, self.r2, self.rank,
                )
            )
        return rows


def ols_normal_equations(
    df: DataFrame, outcome: str, terms: Sequence[Term], cells: Sequence[str] | None = None
) -> Fit:
    """One pass: all products of regressors and outcome, then a k x k solve.

    ``cells`` names the columns the terms read. Rows equal in them are then
    pooled first, map-side, and only pooled rows reach Python: the products
    need no more than count, sum and sum of squares of the outcome per cell.
    A dummy reaches Python as the value of its source column.
    Columns are scaled to unit length before the pseudo-inverse, so its cut-off
    sees collinearity and not units. A collinear design keeps the minimum-norm
    solution and reports its rank.
    """
    y = F.col(outcome).cast("double")
    df = usable(df, y, terms)
    k = len(terms)
    pooled = df.withColumns({"_n": F.lit(1.0), "_s": y, "_q": y * y})
    if cells:
        pooled = pooled.groupBy(*cells).agg(*[F.sum(c).alias(c) for c in ("_n", "_s", "_q")])
    if k > MAX_TERMS:
        raise ValueError(f"{k} terms exceed {MAX_TERMS}")
    products, _ = sparse.gather(sparse.product_entries(pooled, terms, F.col("_n"), F.col("_s"), F.col("_q")), k + 3)
    xx, xy = products[:k, :k], products[:k, k + 1]
    n = int(round(products[k, k]))
    if n == 0:
        raise ValueError("no rows to fit")
    scale = np.sqrt(np.diag(xx))
    scale[scale == 0] = 1.0
    normal = xx / np.outer(scale, scale)
    cutoff = k * np.finfo(float).eps * 100
    bread = np.linalg.pinv(normal, rcond=cutoff, hermitian=True) / np.outer(scale, scale)
    rank = int(np.linalg.matrix_rank(normal, tol=cutoff * np.linalg.norm(normal, 2), hermitian=True))
    sum_y, sum_y2 = products[k, k + 1], products[k + 2, k + 2]
    return Fit(list(terms), y, bread @ xy, bread, rank, n, float(sum_y2 - sum_y**2 / n))


def cluster_scores(df: DataFrame, fit: Fit, cluster: Sequence[str] = CLUSTER) -> DataFrame:
    """Sum of regressor x residual per cluster, with the cluster's squared residuals.

    Partial sums combine map-side, so a cluster may hold any share of the rows.
    """
    # every score reads its own row's key: the filter comes before, never after
    with_e = usable(df, fit.outcome, fit.terms).withColumn("_e", fit.residual())
    return with_e.groupBy(*cluster).agg(
        *[F.sum(t.centred() * F.col("_e")).alias(f"s{i}") for i, t in enumerate(fit.terms)],
        F.sum(F.col("_e") * F.col("_e")).alias("sse"),
    )


def cluster_robust(df: DataFrame, fit: Fit, cluster: Sequence[str] = CLUSTER, hot: Sequence[int] | None = None) -> Fit:
    """Sandwich covariance with the usual small-sample factor; also SSE and R2.

    ``hot`` lists the hashes of clusters with a large share of the rows; without
    it they are found by one more pass. At most ``HOT_CLUSTERS`` sums of k
    numbers come to the driver for them.
    """
    k = len(fit.terms)
    if hot is None:
        hot = design_statistics(df, [], [], cluster=cluster).hot
    rows = usable(df, fit.outcome, fit.terms)
    products, sums = sparse.gather(sparse.score_entries(rows, fit.terms, fit.beta, fit.outcome, cluster, hot), k + 2)
    meat = products[:k, :k] + sum(np.outer(s[:k], s[:k]) for s in sums.values())
    groups = int(round(products[k, k])) + len(sums)
    fit.n_clusters, fit.sse = groups, float(products[k, k + 1])
    factor = 1.0
    if groups > 1 and fit.n > fit.rank:
        factor = groups / (groups - 1) * (fit.n - 1) / (fit.n - fit.rank)
    fit.covariance = factor * fit.bread @ meat @ fit.bread
    return fit


def ols(
    df: DataFrame,
    outcome: str,
    terms: Sequence[Term],
    cluster: Sequence[str] | None = CLUSTER,
    cells: Sequence[str] | None = None,
    hot: Sequence[int] | None = None,
) -> DataFrame:
    """Coefficient table of one regression."""
    fit = ols_normal_equations(df, outcome, terms, cells)
    if cluster:
        cluster_robust(df, fit, cluster, hot)
    return df.sparkSession.createDataFrame(fit.coefficients(), COEFFICIENT_SCHEMA)


def complete_rows(panel: DataFrame, outcome: str, needed: Sequence[str]) -> DataFrame:
    """Rows with every value the design needs; a missing level is allowed, a missing number is not."""
    return panel.dropna(subset=[outcome, *needed])


def covariate_terms(
    rows: DataFrame,
    categorical: Sequence[str],
    numerics: Sequence[str],
    trend: bool,
    also: Sequence[str] = (),
    cluster: Sequence[str] = (),
) -> tuple[list[Term], Statistics, list[str] | None]:
    """Centred trend and covariates, then drop-first dummies.

    Also returns the statistics found, with the levels of the ``also`` columns, and
    the columns to pool rows by, or None where pooling would not pay.
    """
    categorical = [c for c in categorical if c in rows.columns]
    numerics = [c for c in numerics if c in rows.columns]
    measured: list[tuple[str, str | Column]] = [(TREND, month_index("nuanio", "nummes"))] if trend else []
    measured += [(c, c) for c in numerics]
    cells = [*also, *(["nuanio", "nummes"] if trend else []), *numerics, *categorical]
    found = design_statistics(rows, [*also, *categorical], [c for _, c in measured], cells, cluster)
    terms = [numeric(c, name, centre) for (name, c), centre in zip(measured, found.means)]
    return terms + dummy_terms(categorical, found.levels), found, cells if found.pool else None


def event_study(
    panel: DataFrame,
    event_types: Sequence[str] = ("1to2", "2to1"),
    categorical: Sequence[str] = tuple(S.PANEL_CATEGORICAL),
    numerics: Sequence[str] = tuple(S.PANEL_NUMERIC),
    trend: bool = True,
    outcome: str = "volfac",
    cluster: Sequence[str] = CLUSTER,
) -> DataFrame:
    """Dynamic effects by relative month, one regression per event type.

    Types without t = -1 or t = 0 are skipped. Each type costs three
    scans of its rows: levels and means, products, scores. Store the panel partitioned by
    ``event_type`` so that each scan reads its own files only.
    """
    from aforo.operators.panel import baseline_of

    results = []
    for kind in event_types:
        needed = ["t_rel", *cluster, "nuanio", "nummes", *[c for c in numerics if c in panel.columns]]
        rows = complete_rows(panel.filter(F.col("event_type") == kind), outcome, needed)
        covariates, found, cells = covariate_terms(rows, categorical, numerics, trend, ["t_rel"], cluster)
        base = baseline_of(found.levels["t_rel"])
        if base is None:
            continue
        times = [indicator("t_rel", t, f"t_rel__{t}") for t in found.levels["t_rel"] if t != base]
        terms = [intercept(), *times, *covariates]
        fit = cluster_robust(rows, ols_normal_equations(rows, outcome, terms, cells), cluster, found.hot)
        results += [(kind, base, *r) for r in fit.coefficients()]
    table = panel.sparkSession.createDataFrame(
        results, f"event_type string, baseline int, {COEFFICIENT_SCHEMA}"
    )
    return table.withColumn("t_rel", F.regexp_extract("term", r"^t_rel__(-?\d+)$", 1).try_cast("int"))


def coef_interval(coefficients: DataFrame, z: float = Z_95) -> DataFrame:
    return coefficients.withColumns(
        {
            "ci_low": F.col("coef") - z * F.col("std_error"),
            "ci_high": F.col("coef") + z * F.col("std_error"),
        }
    )


def did_ols_cluster(
    panel: DataFrame,
    categorical: Sequence[str] = tuple(S.PANEL_CATEGORICAL),
    numerics: Sequence[str] = tuple(S.PANEL_NUMERIC),
    outcome: str = "volfac",
    cluster: Sequence[str] = CLUSTER,
) -> DataFrame:
    """Difference-in-differences by regression with covariates and clustered errors."""
    numerics = [c for c in numerics if c in panel.columns]
    rows = complete_rows(panel, outcome, ["treated", "post", *cluster, *numerics])
    both = F.col("treated") * F.col("post")
    covariates, found, cells = covariate_terms(rows, categorical, numerics, False, ["treated", "post"], cluster)
    terms = [
        intercept(),
        numeric("treated", "treated"),
        numeric("post", "post"),
        numeric(both, "treated_post"),
        *covariates,
    ]
    return ols(rows, outcome, terms, cluster, cells, found.hot)


def did_basic_t(panel: DataFrame, value: str = "volfac", cluster: Sequence[str] = CLUSTER) -> DataFrame:
    """The basic effect with its clustered error and t: the interaction of the saturated regression."""
    both = F.col("treated").cast("double") * F.col("post")
    terms = [intercept(), numeric("treated", "treated"), numeric("post", "post"), numeric(both, "effect")]
    found = ols(panel, value, terms, cluster).filter(F.col("term") == "effect")
    return found.select(F.col("coef").alias("effect"), "std_error", "t_stat", "n_obs", "n_clusters")
