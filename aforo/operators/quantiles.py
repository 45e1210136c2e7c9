"""Exact quantiles per group, for groups of any size.

Small groups use the built-in ``percentile``. It keeps every distinct value of
a group in one buffer, so groups above ``hot_rows`` take another way: a
bounded sketch brackets each wanted rank, rows outside the bracket are only
counted, and the few distinct values inside are ranked, by ranges where they are
many. No step moves a whole group to one task, and the answer is exact because
the counts are.

Where a map task rarely sees two rows of a group, rows are shuffled once, sorted and
ranked in place, and no group has a buffer of its own. Where too many groups are hot
to name them, the distinct values of all groups are ranked by ranges, without sketches.

The source is read once without hot groups apart from the sketch that looks for
them, else three times: that sketch, one aggregation of everything, and one pass
that writes the hot groups' values as a narrow table for the brackets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aforo.operators.aggregates import small_distinct
from aforo.session import stored

HOT_ROWS = 1_000_000
MAX_BROADCAST_GROUPS = 20_000
#: Frequent-items sketches side by side, one for each share of the keys, and the keys each one tracks.
HASH_BUCKETS, TRACKED = 256, 4_096
CUTS = 500
SKETCH_ACCURACY = 10_000
BRACKET = ("_i", "_frac", "_lo", "_hi", "_min", "_max", "_a", "_z")


def percentile_column(value: str, probs: Sequence[float], method: str = "linear") -> Column:
    """Quantiles of one column as an array, one buffer for all of them."""
    if method == "linear":
        return F.percentile(value, F.array(*[F.lit(float(p)) for p in probs]))
    if method == "nearest":
        ordered = F.array_sort(F.collect_list(value))
        picks = [
            F.get(ordered, F.round(F.lit(float(p)) * (F.size(ordered) - 1)).cast("int"))
            for p in probs
        ]
        return F.array(*picks)
    raise ValueError(f"unknown method {method!r}")


def approximate_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], accuracy: int = 10_000
) -> DataFrame:
    """Sketch quantiles: one pass, bounded memory, rank error 1/accuracy."""
    array = F.percentile_approx(value, F.array(*[F.lit(float(p)) for p in probs.values()]), accuracy)
    out = df.groupBy(*keys).agg(array.alias("_q"))
    return out.select(*keys, *[F.col("_q")[i].alias(name) for i, name in enumerate(probs)])


def hot_groups(df: DataFrame, keys: Sequence[str], hot_rows: int) -> list[int]:
    """Hashes of the groups with at least ``hot_rows`` rows, at most ``HASH_BUCKETS * TRACKED / 2`` numbers.

    One pass over the keys. Frequent-items sketches of bounded size, one for each
    of 256 shares of the keys, count in parallel and merge. A sketch counts too
    much rather than too little; a group just above ``hot_rows`` is overlooked only
    where that is less than some millionth of the rows.
    """
    if not keys:
        return [0] if df.agg(F.count(F.lit(1))).first()[0] >= hot_rows else []
    share = F.pmod(F.hash(*keys), F.lit(HASH_BUCKETS))
    top = F.call_function("approx_top_k", F.xxhash64(*keys), F.lit(TRACKED // 2), F.lit(TRACKED))
    sketches = df.select(*keys).groupBy(share).agg(top.alias("_t"))
    found = sketches.select(F.explode("_t").alias("t")).filter(F.col("t.count") >= hot_rows)
    return [r["item"] for r in found.select("t.item").collect()]


def join_on_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Null-safe equi-join that keeps the left keys."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(renamed, on, how).drop(*[f"_r_{k}" for k in keys])


def group_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: dict[str, float],
    aggregates: Sequence[Column] = (),
    method: str = "linear",
    hot_rows: int | None = HOT_ROWS,
    small_groups: bool = False,
    distinct: dict[str, str] | None = None,
) -> DataFrame:
    """Aggregates and exact quantiles per group, named by ``probs``.

    ``distinct`` names distinct counts of columns with few values.

    One aggregation when no group is hot. ``small_groups`` says that a map task
    rarely sees two rows of a group: then raw rows are shuffled, which are
    narrower than partial buffers, provided no group was found hot. Otherwise the
    aggregation keeps exact buffers for cold groups and sketches for hot ones,
    whose quantiles come from brackets. More than ``MAX_BROADCAST_GROUPS`` hot
    groups: all quantiles come from ranges of values.
    """
    keys = list(keys)
    if aggregates and not keys:
        raise ValueError("aggregates next to quantiles need a group key")
    sets = [small_distinct(column).alias(name) for name, column in (distinct or {}).items()]
    if hot_rows is None:
        return _plain(df, keys, value, probs, [*aggregates, *sets], method)
    hot = hot_groups(df, keys, hot_rows)
    if not hot and small_groups and keys:
        return _sorted(df, keys, value, probs, aggregates, method, distinct or {})
    if keys and len(hot) > MAX_BROADCAST_GROUPS:
        counts = [F.count_distinct(column).alias(name) for name, column in (distinct or {}).items()]
        return _by_ranges(df, keys, value, probs, [*aggregates, *counts], method)
    if hot and small_groups and keys:
        is_hot = F.xxhash64(*keys).isin(hot)
        cold = _sorted(df.filter(~is_hot), keys, value, probs, aggregates, method, distinct or {})
        return cold.unionByName(_bracketed(df.filter(is_hot), keys, value, probs, [*aggregates, *sets], method, hot, hot_rows))
    aggregates = [*aggregates, *sets]
    if not hot:
        return _plain(df, keys, value, probs, aggregates, method)
    return _bracketed(df, keys, value, probs, aggregates, method, hot, hot_rows)


def _bracketed(df, keys, value, probs, aggregates, method, hot, hot_rows) -> DataFrame:
    """Exact buffers for cold groups, sketches and brackets for the ``hot`` ones."""
    every = not keys
    is_hot = F.lit(True) if every else F.xxhash64(*keys).isin(hot)
    marked = df.withColumn("_cold", F.when(~is_hot, F.col(value))).withColumn("_v", F.when(is_hot, _element(df, value, method)))
    exact = [] if every else [percentile_column("_cold", list(probs.values()), method).alias("_q")]
    whole = stored(marked.groupBy(*keys).agg(*aggregates, *exact, *_sketch()), "group-aggregates")
    sketch = whole.filter("_n > 0").select(*keys, "_n", "_min", "_max", "_cuts")
    narrow = stored(marked.filter(is_hot & F.col("_v").isNotNull()).select(*keys, "_v"), "hot-values")
    found = _select(narrow, sketch, keys, probs, method, hot_rows)
    if not keys:
        return found
    renamed = found.withColumnsRenamed({name: f"_h{i}" for i, name in enumerate(probs)})
    out = join_on_keys(whole, renamed, keys, "left")
    # a group without any value has no quantile but is a group
    picked = {n: F.coalesce(f"_h{i}", F.col("_q")[i]) for i, n in enumerate(probs)}
    drop = ["_q", "_n", "_min", "_max", "_cuts", *[f"_h{i}" for i in range(len(probs))]]
    return out.withColumns(picked).drop(*drop)


def _element(df: DataFrame, value: str, method: str) -> Column:
    """An element of the group keeps its type, a value between two is a double."""
    return F.col(value).cast("double" if method == "linear" else df.schema[value].dataType)


def _sketch() -> list[Column]:
    cuts = F.percentile_approx("_v", F.array(*[F.lit(i / CUTS) for i in range(1, CUTS)]), SKETCH_ACCURACY)
    return [F.count("_v").alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"), cuts.alias("_cuts")]


def _plain(df, keys, value, probs, aggregates, method) -> DataFrame:
    out = df.groupBy(*keys).agg(*aggregates, percentile_column(value, list(probs.values()), method).alias("_q"))
    return out.withColumns({name: F.col("_q")[i] for i, name in enumerate(probs)}).drop("_q")


def _ranks(n: Column, p: float, method: str) -> tuple[Column, Column, Column]:
    """Lower and upper rank (from 0) of a quantile of ``n`` values and the share of the way between them."""
    at = F.lit(p) * (n - 1)
    if method == "nearest":
        low = F.round(at).cast("long")
        return low, low, F.lit(0.0)
    return F.floor(at).cast("long"), F.ceil(at).cast("long"), at - F.floor(at)


def _between(low: Column, high: Column, share: Column, method: str) -> Column:
    if method == "nearest":
        return low
    return F.when((share == 0) | (low == high), low).otherwise((1 - share) * low + share * high)


def _sorted(df, keys, value, probs, aggregates, method, distinct) -> DataFrame:
    """One exchange of the rows, whose order gives ranks; the window may spill, unlike a buffer."""
    if method not in ("linear", "nearest"):
        raise ValueError(f"unknown method {method!r}")
    rows = df.repartition(*keys).withColumn("_v", _element(df, value, method))
    for i, column in enumerate(distinct.values()):
        place = F.dense_rank().over(Window.partitionBy(*keys).orderBy(F.col(column).asc_nulls_last()))
        rows = rows.withColumn(f"_d{i}", F.when(F.col(column).isNotNull(), place).otherwise(0))
    inner = Window.partitionBy(*keys).orderBy(F.col("_v").asc_nulls_last())
    whole = inner.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumns({"_r": F.row_number().over(inner) - 1, "_n": F.count("_v").over(whole)})
    ranks = {name: _ranks(F.col("_n"), float(p), method) for name, p in probs.items()}
    out = rows.groupBy(*keys).agg(
        *aggregates,
        *[F.max(f"_d{i}").cast("long").alias(name) for i, name in enumerate(distinct)],
        *[F.max(F.when(F.col("_r") == rank[end], F.col("_v"))).alias(f"_q{i}{end}") for i, rank in enumerate(ranks.values()) for end in (0, 1)],
        F.first("_n").alias("_n"),
    )
    picked = {name: _between(F.col(f"_q{i}0"), F.col(f"_q{i}1"), rank[2], method) for i, (name, rank) in enumerate(ranks.items())}
    return out.withColumns(picked).drop("_n", *[f"_q{i}{end}" for i in range(len(probs)) for end in (0, 1)])


def _by_ranges(df, keys, value, probs, aggregates, method) -> DataFrame:
    """Quantiles of all groups from ranges of their distinct values; work and shuffles grow with the rows."""
    whole = stored(df.groupBy(*keys).agg(*aggregates, F.count(value).alias("_n")), "group-aggregates")
    values = df.select(*keys, _element(df, value, method).alias("_v")).filter(F.col("_v").isNotNull())
    counts = stored(values.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c")), "group-values")
    ranked = join_on_keys(_ranked(counts, keys, True), whole.select(*keys, "_n"), keys)
    ranks = {name: _ranks(F.col("_n"), float(p), method) for name, p in probs.items()}
    holds = lambda rank: (F.col("_start") <= rank) & (F.col("_end") > rank)
    found = ranked.groupBy(*keys).agg(
        *[F.max(F.when(holds(rank[end]), F.col("_v"))).alias(f"_h{i}{end}") for i, rank in enumerate(ranks.values()) for end in (0, 1)]
    )
    out = join_on_keys(whole, found, keys, "left")
    picked = {name: _between(F.col(f"_h{i}0"), F.col(f"_h{i}1"), rank[2], method) for i, (name, rank) in enumerate(ranks.items())}
    return out.withColumns(picked).drop("_n", *[f"_h{i}{end}" for i in range(len(probs)) for end in (0, 1)])


def select_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: dict[str, float],
    method: str = "linear",
    stop_rows: int = HOT_ROWS,
) -> DataFrame:
    """Exact quantiles of arbitrarily large groups by bracketing; groups without values are left out."""
    keys = list(keys)
    narrow = stored(df.select(*keys, _element(df, value, method).alias("_v")).filter(F.col("_v").isNotNull()), "hot-values")
    sketch = narrow.groupBy(*keys).agg(*_sketch()).filter("_n > 0")
    return _select(narrow, sketch, keys, probs, method, stop_rows)


def _select(narrow: DataFrame, sketch: DataFrame, keys: list[str], probs: dict[str, float], method: str, stop_rows: int) -> DataFrame:
    named = [(name, float(p)) for name, p in probs.items()]
    groups = [*keys, "_i"]
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(p).alias("p")) for i, (_, p) in enumerate(named)])
    sketch = sketch.withColumn("_w", F.explode(wanted))
    at = F.col("_w.p") * (F.col("_n") - 1)
    if method == "nearest":
        low = high = F.round(at).cast("long")
    else:
        low, high = F.floor(at).cast("long"), F.ceil(at).cast("long")
    located = sketch.select(
        *keys,
        F.col("_w.i").alias("_i"),
        (at - low if method == "linear" else F.lit(0.0)).alias("_frac"),
        low.alias("_lo"),
        high.alias("_hi"),
        "_n", "_min", "_max", "_cuts",
    )
    brackets = stored(_brackets(located, keys), "brackets")
    inside = stored(_inside(narrow, brackets, keys), "inside")
    counts = stored(_counts(inside, brackets, groups), "bracket-counts")
    miss = (F.col("_below") > F.col("_lo")) | (F.col("_below") + F.col("_in") <= F.col("_hi"))
    if not counts.filter(miss).isEmpty():
        # a bracket that missed its rank becomes the whole range of its group
        brackets = stored(counts.select(
            *keys, *BRACKET[:-2],
            F.when(miss, F.col("_min")).otherwise(F.col("_a")).alias("_a"),
            F.when(miss, F.col("_max")).otherwise(F.col("_z")).alias("_z"),
        ), "brackets")
        inside = stored(_inside(narrow, brackets, keys), "inside")
        counts = stored(_counts(inside, brackets, groups), "bracket-counts")
    targets = counts.select(
        *groups, "_frac",
        (F.col("_lo") - F.col("_below")).alias("_lo"),
        (F.col("_hi") - F.col("_below")).alias("_hi"),
    )
    largest = counts.agg(F.max("_distinct")).first()[0] or 0
    ranked = _ranked(inside.filter(F.col("_v").isNotNull()), groups, largest > stop_rows)
    hit = join_on_keys(ranked, targets, groups).filter(
        (F.col("_start") <= F.col("_hi")) & (F.col("_end") > F.col("_lo"))
    )
    between = F.min("_v") + F.first("_frac") * (F.max("_v") - F.min("_v"))
    whole = (F.first("_frac") == 0) | (F.min("_v") == F.max("_v"))
    linear = F.when(whole, F.min("_v")).otherwise(between)
    picked = hit.groupBy(*groups).agg((linear if method == "linear" else F.min("_v")).alias("_q"))
    return picked.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_i") == i, F.col("_q"))).alias(name) for i, (name, _) in enumerate(named)]
    )


def _ranked(distinct: DataFrame, groups: list[str], many: bool) -> DataFrame:
    """Distinct values ``_v`` with counts ``_c`` and the ranks ``_start`` to ``_end`` that each one covers.

    Where a group has many, values are dealt by ranges; a range adds the counts of
    the ranges before it, one row per range and group.
    """
    if not many:
        upto = Window.partitionBy(*groups).orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ranked = distinct.withColumn("_end", F.sum("_c").over(upto))
        return ranked.withColumn("_start", F.col("_end") - F.col("_c"))
    laid = stored(distinct.repartitionByRange(*groups, "_v").withColumn("_p", F.spark_partition_id()), "ranges")
    before = Window.partitionBy(*groups).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    parts = laid.groupBy(*groups, "_p").agg(F.sum("_c").alias("_s"))
    parts = parts.withColumn("_before", F.coalesce(F.sum("_s").over(before), F.lit(0))).drop("_s")
    upto = Window.partitionBy(*groups, "_p").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = join_on_keys(laid, parts, [*groups, "_p"]).withColumn("_end", F.col("_before") + F.sum("_c").over(upto))
    return ranked.withColumn("_start", F.col("_end") - F.col("_c")).drop("_p", "_before")


def _brackets(located: DataFrame, keys: list[str]) -> DataFrame:
    """Two neighbouring sketch cuts on each side of a wanted rank."""
    step = F.floor(F.col("_lo") / F.greatest(F.col("_n"), F.lit(1)) * CUTS).cast("int")
    step_hi = F.floor(F.col("_hi") / F.greatest(F.col("_n"), F.lit(1)) * CUTS).cast("int")
    # _cuts[j] (0-based) sits near rank share (j + 1) / CUTS
    a = F.when(step - 2 < 0, F.col("_min")).otherwise(F.get("_cuts", step - 2))
    z = F.when(step_hi + 1 > CUTS - 2, F.col("_max")).otherwise(F.get("_cuts", step_hi + 1))
    return located.select(*keys, *BRACKET[:-2], a.alias("_a"), z.alias("_z"))


def _attach(rows: DataFrame, brackets: DataFrame, keys: list[str]) -> DataFrame:
    if not keys:
        # one group: its few brackets are literals, no join
        structs = [
            F.struct(*[F.lit(r[c]).cast(brackets.schema[c].dataType).alias(c) for c in BRACKET])
            for r in brackets.collect()
        ]
        if not structs:
            return rows.limit(0).select(*[F.lit(None).cast(brackets.schema[c].dataType).alias(c) for c in BRACKET], "_v")
        return rows.withColumn("_t", F.explode(F.array(*structs))).select(
            *[F.col(f"_t.{c}").alias(c) for c in BRACKET], "_v"
        )
    n = brackets.count()
    right = F.broadcast(brackets) if n <= MAX_BROADCAST_GROUPS else brackets
    return join_on_keys(rows, right, keys)


def _inside(rows: DataFrame, brackets: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of the distinct values in each bracket, and of all rows below it (value null)."""
    near = _attach(rows, brackets, keys).filter(F.col("_v") <= F.col("_z"))
    kept = F.when(F.col("_v") >= F.col("_a"), F.col("_v"))
    return near.select(*keys, "_i", kept.alias("_v")).groupBy(*keys, "_i", "_v").agg(F.count(F.lit(1)).alias("_c"))


def _counts(inside: DataFrame, brackets: DataFrame, groups: list[str]) -> DataFrame:
    known = F.col("_v").isNotNull()
    sums = inside.groupBy(*groups).agg(
        F.sum(F.when(known, 0).otherwise(F.col("_c"))).alias("_below"),
        F.sum(F.when(known, F.col("_c")).otherwise(0)).alias("_in"),
        F.count("_v").alias("_distinct"),
    )
    return join_on_keys(brackets, sums, groups)
