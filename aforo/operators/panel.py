"""Event panels: transitions, controls, relative time and pre-trend checks."""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aforo import schema as S
from aforo.functions.hashing import key_hash
from aforo.functions.measures import month_index
from aforo.operators.aggregates import distinct_values, pivot_mean
from aforo.operators.selection import smallest
from aforo.session import checkpoint_dir, scratch_path, stored

WINDOW = 6
CONTROLS_PER_TREATED = 2
UNIT = ["codcon", "codudu"]


def with_month(df: DataFrame, name: str = "mes") -> DataFrame:
    return df.withColumn(name, month_index("nuanio", "nummes"))


def unit_months(df: DataFrame, keys: Sequence[str] = UNIT) -> DataFrame:
    """One state per unit and month: 1 if any record of the month is not subsidised, else 0.

    ``otro`` marks months with a record that is anything but not subsidised.
    Coding the state as an integer keeps the aggregation in generated code; it
    combines map-side, so a unit with very many records is no problem.
    """
    state = F.when(F.col("situdu") == S.NOT_SUBSIDISED, 1).when(F.col("situdu") == S.SUBSIDISED, 0)
    other = F.when(F.col("situdu") == S.NOT_SUBSIDISED, 0).otherwise(1)
    return with_month(df).groupBy(*keys, "mes").agg(F.max(state).alias("estado"), F.max(other).alias("otro"))


def unit_history(df: DataFrame, keys: Sequence[str] = UNIT) -> DataFrame:
    """First change of state in each direction per unit, and whether it was never subsidised.

    One pass for treated and control units alike. The window runs over
    unit-months, at most one row per month and unit.
    """
    before = Window.partitionBy(*keys).orderBy("mes").rowsBetween(Window.unboundedPreceding, -1)
    prev = F.last("estado", ignorenulls=True).over(before)

    def first_change(old: int, new: int) -> Column:
        return F.min(F.when((F.col("_prev") == old) & (F.col("estado") == new), F.col("mes")))

    return (
        unit_months(df, keys)
        .withColumn("_prev", prev)
        .groupBy(*keys)
        .agg(
            first_change(0, 1).alias("mes_1to2"),
            first_change(1, 0).alias("mes_2to1"),
            (F.max("otro") == 0).alias("nunca"),
        )
    )


def events_of(history: DataFrame, direction: str, keys: Sequence[str] = UNIT) -> DataFrame:
    month = F.col(f"mes_{direction}")
    return history.filter(month.isNotNull()).select(*keys, month.alias("mes_evento"))


def first_transition(df: DataFrame, direction: str = "1to2", keys: Sequence[str] = UNIT) -> DataFrame:
    """First month in which a unit's state changes in the given direction."""
    return events_of(unit_history(df, keys), direction, keys)


def never_treated(df: DataFrame, keys: Sequence[str] = UNIT) -> DataFrame:
    """Units whose every record is not subsidised; needs no order, hence no window."""
    other = F.when(F.col("situdu") == S.NOT_SUBSIDISED, 0).otherwise(1)
    return df.groupBy(*keys).agg(F.max(other).alias("_o")).filter(F.col("_o") == 0).select(*keys)


def sample_controls(
    treated: DataFrame,
    candidates: DataFrame,
    ratio: int = CONTROLS_PER_TREATED,
    seed: int = 42,
    keys: Sequence[str] = UNIT,
    allow_short: bool = False,
) -> DataFrame:
    """``ratio`` controls per treated unit, each with a pseudo event month.

    Too few candidates raise an error unless ``allow_short`` says that all of
    them will do.

    The lowest key hashes are taken. The pseudo month follows the distribution
    of the treated months: a second hash picks a position among the treated
    events in month order. Only the month histogram, one row per calendar
    month, reaches the driver.
    """
    histogram = treated.groupBy("mes_evento").count().orderBy("mes_evento").collect()
    n_treated = sum(r["count"] for r in histogram)
    if n_treated == 0:
        return candidates.select(*keys, F.lit(None).cast("int").alias("mes_evento")).limit(0)
    hashed = candidates.select(*keys, key_hash(keys, seed, candidates).alias("_h"))
    if not allow_short and (found := candidates.count()) < ratio * n_treated:
        raise ValueError(f"{ratio * n_treated} controls wanted, {found} candidates; allow_short takes them all")
    chosen = smallest(hashed, "_h", ratio * n_treated, ties=keys)
    position = key_hash(keys, seed + 1, chosen) % F.lit(n_treated)
    upto = list(itertools.accumulate(r["count"] for r in histogram))
    bounds = F.array(*[F.lit(u).cast("long") for u in upto])
    months = F.array(*[F.lit(r["mes_evento"]) for r in histogram])
    return chosen.select(*keys, position.alias("_pos")).select(
        *keys, F.get(months, F.size(F.filter(bounds, lambda b: b <= F.col("_pos")))).alias("mes_evento")
    )


def event_panel(
    df: DataFrame, events: DataFrame, window: int = WINDOW, keys: Sequence[str] = UNIT
) -> DataFrame:
    """Records of the units with an event, within ``window`` months of it.

    Further columns of ``events`` are carried along. An inner equi-join without
    a hint: Catalyst and AQE broadcast the events when they measure small and
    split skewed units otherwise.
    """
    ev = events.withColumnsRenamed({k: f"_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & (F.col(k) == F.col(f"_{k}"))
    return (
        with_month(df)
        .join(ev, on)
        .withColumn("t_rel", F.col("mes") - F.col("mes_evento"))
        .filter(F.col("t_rel").between(-window, window))
        .drop(*[f"_{k}" for k in keys], "mes", "mes_evento")
    )


def event_study_panel(df: DataFrame, window: int = WINDOW) -> DataFrame:
    """Both event types stacked, told apart by ``event_type``: one history, one join."""
    kinds = F.array(
        *[
            F.struct(F.lit(d).alias("event_type"), F.col(f"mes_{d}").alias("mes_evento"))
            for d in ("1to2", "2to1")
        ]
    )
    events = (
        unit_history(df)
        .select(*UNIT, F.explode(kinds).alias("e"))
        .select(*UNIT, "e.event_type", "e.mes_evento")
        .filter(F.col("mes_evento").isNotNull())
    )
    return event_panel(df, events, window)


def with_post(panel: DataFrame) -> DataFrame:
    return panel.withColumn("post", (F.col("t_rel") >= 0).cast("int"))


def combine_panels(treated: DataFrame, controls: DataFrame) -> DataFrame:
    """Treated and control records with the ``treated`` and ``post`` indicators."""
    return with_post(
        treated.withColumn("treated", F.lit(1)).unionByName(controls.withColumn("treated", F.lit(0)))
    )


def did_panel(
    df: DataFrame, window: int = WINDOW, ratio: int = CONTROLS_PER_TREATED, seed: int = 42,
    allow_short: bool = False,
) -> DataFrame:
    """The difference-in-differences panel around losing the subsidy.

    The unit histories are read several times (histogram, sampling, join), so
    they are checkpointed: one narrow row per unit. Treated and control events
    then join the records once.
    """
    checkpoint_dir(df.sparkSession)
    history = unit_history(df).checkpoint()
    treated = events_of(history, "1to2")
    controls = sample_controls(treated, history.filter("nunca"), ratio, seed, allow_short=allow_short)
    events = treated.withColumn("treated", F.lit(1)).unionByName(controls.withColumn("treated", F.lit(0)))
    return with_post(event_panel(df, events, window))


def both_panels(
    df: DataFrame, window: int = WINDOW, ratio: int = CONTROLS_PER_TREATED, seed: int = 42, allow_short: bool = False
) -> tuple[DataFrame, DataFrame]:
    """The event panel and the difference-in-differences panel from two scans of the records.

    One stored history serves all events. Events of either type, and the controls,
    join the records together; the joined records are stored once, apart for each
    kind, and both panels read the kinds they need.
    """
    history = stored(unit_history(df), "unit-history")
    kinds = {kind: events_of(history, kind) for kind in ("1to2", "2to1")}
    kinds["control"] = sample_controls(kinds["1to2"], history.filter("nunca"), ratio, seed, allow_short=allow_short)
    events = reduce(DataFrame.unionByName, [e.withColumn("kind", F.lit(kind)) for kind, e in kinds.items()])
    path = scratch_path(df.sparkSession, "panels")
    joined = event_panel(df, events, window)
    joined.write.partitionBy("kind").parquet(path)
    rows = df.sparkSession.read.schema(joined.schema).parquet(path)
    types = rows.filter(F.col("kind").isin("1to2", "2to1")).withColumnRenamed("kind", "event_type")
    treated = (F.col("kind") == "1to2").cast("int")
    did = with_post(rows.filter(F.col("kind").isin("1to2", "control")).withColumn("treated", treated)).drop("kind")
    return types, did


def pretrend_means(panel: DataFrame, value: str = "volfac") -> DataFrame:
    return (
        panel.filter(F.col("t_rel") < 0)
        .groupBy("t_rel", "treated")
        .agg(F.avg(value).alias(f"{value}_mean"))
        .orderBy("t_rel", "treated")
    )


def pretrend_pivot(panel: DataFrame, value: str = "volfac") -> DataFrame:
    return pivot_mean(panel.filter(F.col("t_rel") < 0), "t_rel", "treated", [0, 1], value)


def pretrend_gap(panel: DataFrame, value: str = "volfac") -> DataFrame:
    """Treated minus control before the event: mean and deviation of the gap over months."""
    gap = pretrend_pivot(panel, value).select((F.col("1") - F.col("0")).alias("gap"))
    return gap.agg(
        F.avg("gap").alias("gap_mean"),
        F.stddev_samp("gap").alias("gap_std"),
        F.count("gap").alias("n_periods"),
    )


def event_times(panel: DataFrame) -> DataFrame:
    """Distinct relative months per event type with the baseline: -1, else 0, else none."""
    levels = panel.groupBy("event_type").agg(F.array_sort(F.collect_set("t_rel")).alias("_t"))
    baseline = F.when(F.array_contains("_t", -1), -1).when(F.array_contains("_t", 0), 0)
    return levels.select(
        "event_type", baseline.alias("baseline"), F.explode("_t").alias("t_rel")
    ).filter(F.col("baseline").isNotNull() & (F.col("t_rel") != F.col("baseline")))


def baseline_of(times: Sequence[int]) -> int | None:
    return -1 if -1 in times else (0 if 0 in times else None)


def did_basic(panel: DataFrame, value: str = "volfac") -> DataFrame:
    """Difference of differences of the four cell means."""

    def cell(treated: int, post: int) -> Column:
        return F.avg(F.when((F.col("treated") == treated) & (F.col("post") == post), F.col(value)))

    means = panel.agg(
        cell(1, 1).alias("treated_post"),
        cell(1, 0).alias("treated_pre"),
        cell(0, 1).alias("control_post"),
        cell(0, 0).alias("control_pre"),
    )
    effect = (F.col("treated_post") - F.col("treated_pre")) - (F.col("control_post") - F.col("control_pre"))
    return means.withColumn("effect", effect)
