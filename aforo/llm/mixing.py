"""Mixing sources to target weights by weighted sampling without replacement.

Each source has a token target. A source whose target is k and a fraction times
its size gives k complete epochs, then documents in Efraimidis-Spirakis order
(``-ln(u) / quality``, smallest first; ``u`` from a hash of id and text) while the
running sum stays within what is left; the document that crosses the budget is
taken if that brings the sum nearer to it.

No source is sorted. The keys of a source are counted in ``BUCKETS`` buckets by
``key / (1 + key)``, which keeps the large keys of poor documents apart as well;
only the bucket where the budget ends is ordered. A second level of buckets splits that bucket by the same rule, so a
task orders less than a ten-thousandth of a source. What remains is one cut per
source, and rows are compared with it.

Null source: a source of its own, last. Null quality, or one that is not above
0: ``LEAST_QUALITY``. Size null: 0. Repeated rows have equal keys; ties follow
id, size and text hash, and copies that still tie are taken together. Size 0
documents are taken as often as any. Empty table: no rows.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aforo.llm.common import WORD, packed, pick, stored
from aforo.session import ROWS_PER_TASK

BUCKETS = 4096
LEAST_QUALITY = 1e-3
WEIGHTS = (5.0, 2.0, 1.0)
QUALITY_DECAY = 1e-4


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_quality(text: Column) -> Column:
    """Share of characters that stand in words of letters, between 0 and 1; 0 for empty texts."""
    odd = F.coalesce(F.regexp_count(text, F.lit(r"[0-9|{}<>_=#@\\/]")), F.lit(0))
    return F.lit(1.0) - odd / F.greatest(F.length(text), F.lit(1))


def quality_features(text: Column) -> list[Column]:
    """Shares of a text's characters: not letters, digits and symbols, capitals, ends of sentences, line ends."""
    n = F.greatest(F.length(text), F.lit(1))
    share = lambda pattern: F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0)) / n
    return [share(p) for p in (r"[^\p{L}\s]", r"[0-9|{}<>_=#@\\/]", r"\p{Lu}", r"[.!?](?=\s|$)", r"\n")]


def fitted_quality(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label_id: str = "doc_id", label: str = "quality"
) -> Column:
    """Chance of the label 1 by :func:`quality_features`, a column over ``_t`` for :func:`mix`.

    A logistic regression over all labelled documents; an id that has several
    labels counts with the greatest. Weights are rounded, so that the order in
    which partial sums arrive does not show. Without both labels:
    :func:`text_quality`. Null texts have no quality.
    """
    marks = pick(labels, key=label_id, label=label).groupBy(F.col("key").cast("long").alias("key")).agg(F.max("label").cast("double").alias("label"))
    texts = pick(docs, id=doc_id, t=text).filter("t IS NOT NULL")
    names = [f"f{i}" for i in range(len(quality_features(F.col("t"))))]
    # measured before the join, so that no text is shuffled
    measured = texts.select(F.col("id").cast("long").alias("key"), *[c.alias(n) for n, c in zip(names, quality_features(F.col("t")), strict=True)])
    rows = stored(measured.join(marks.filter("label IN (0, 1)"), "key").select("label", *names), "mixing-labelled")
    counts = [r["count"] for r in rows.groupBy("label").count().collect()]
    if len(counts) < 2:
        return text_quality(F.col("_t"))
    # a pass has a task for each ROWS_PER_TASK rows, not for each file of the wide rows that made them
    rows = rows.coalesce(math.ceil(sum(counts) / ROWS_PER_TASK))
    model = LogisticRegression(regParam=QUALITY_DECAY, maxIter=50).fit(VectorAssembler(inputCols=names, outputCol="features").transform(rows))
    score = F.lit(round(float(model.intercept), 4))
    for weight, feature in zip(model.coefficients.toArray(), quality_features(F.col("_t")), strict=True):
        score = score + F.lit(round(float(weight), 4)) * feature
    return F.when(F.col("_t").isNotNull(), 1 / (1 + F.exp(-score)))


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """Targets by water filling over ``(source, source_size)``, one row per source.

    A source is full at ``most`` times its size. Sorted by ``size / weight``,
    sources fill in that order: the first i are full if the level that the rest
    would get reaches theirs. The windows run over a row per source.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int"))
    everything = Window.partitionBy()
    fill = Window.orderBy(F.col("_cap") / F.col("_w"), "_n")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    after = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(after)
    return (
        sizes.withColumns({"_n": F.row_number().over(by_name), "_w": weight, "_cap": F.col("source_size") * F.lit(float(most))})
        .withColumn("_total", F.sum("source_size").over(everything) * F.lit(share))
        .withColumn("_level", level)
        .withColumn("_full", F.col("_level") * F.col("_w") >= F.col("_cap"))
        .withColumn("_rest", F.min(F.when(~F.col("_full"), F.struct(F.col("_cap") / F.col("_w"), "_n", "_level"))).over(everything)["_level"])
        .withColumn("target", F.when(F.col("_rest").isNull(), F.col("_cap")).otherwise(F.least("_cap", F.col("_rest") * F.col("_w"))))
        .select("source", "source_size", "target")
    )


def _running(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Size of each bucket and of those before it; a row per source and bucket."""
    sums = rows.groupBy(*keys, name).agg(F.sum("size").alias("_sum"))
    before = Window.partitionBy(*keys).orderBy(name).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return sums.withColumn("_upto", F.sum("_sum").over(before))


def mix(
    docs: DataFrame,
    doc_id: str = "doc_id",
    source: str = "source",
    text: str = "text",
    size: Column | None = None,
    quality: Column | None = None,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 42,
) -> DataFrame:
    """A row per document: doc_id, source, size, source_size, target, times, taken, text_hash.

    ``times`` says how often the mix takes the document, ``taken`` its tokens.
    Size and quality are columns over ``_t``, the text; by default its words and
    :func:`text_quality`. The measured rows are stored once, texts are not.
    """
    size = word_count(F.col("_t")) if size is None else F.coalesce(size.cast("long"), F.lit(0))
    quality = text_quality(F.col("_t")) if quality is None else quality
    rows = pick(docs, doc_id=doc_id, source=source, _t=text)
    rows = rows.withColumns({"size": size, "_q": F.greatest(F.coalesce(quality.cast("double"), F.lit(0.0)), F.lit(LEAST_QUALITY))})
    rows = rows.withColumn("_h", F.xxhash64("_t"))
    u = (F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.col("_h"), F.lit(seed)), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    rows = rows.withColumn("_key", -F.log(u) / F.col("_q")).drop("_t", "_q")
    place = F.col("_key") / (1 + F.col("_key"))
    fine = F.least(F.floor(place * (BUCKETS * BUCKETS)), F.lit(BUCKETS * BUCKETS - 1))
    rows = stored(rows.withColumns({"_a": F.floor(fine / BUCKETS), "_b": F.pmod(fine, F.lit(BUCKETS))}), "mixing-sizes")

    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights, share, most)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    # a target that floating point leaves a hair under whole epochs is whole
    whole = F.floor(ratio + F.lit(1e-9))
    targets = stored(
        targets.withColumn("_epochs", whole.cast("long"))
        .withColumn("_left", F.greatest(F.col("target") - F.col("_epochs") * F.col("source_size"), F.lit(0.0)))
        .withColumn("_s", F.struct("source")),
        "mixing-targets",
    )
    same = rows.withColumn("_s", F.struct("source"))

    def cut(level: DataFrame, keys: list[str], name: str) -> DataFrame:
        """The first bucket whose end lies beyond what is left."""
        over = level.join(targets.select("_s", F.col("_left").alias("_own")), "_s")
        found = over.filter(F.col("_base") + F.col("_upto") > F.col("_own"))
        first = F.min(F.struct(F.col(name), F.col("_base") + F.col("_upto") - F.col("_sum")))
        return found.groupBy(*keys).agg(first.alias("_f")).select(*keys, F.col(f"_f.{name}"), F.col("_f.col2").alias("_base"))

    first = cut(_running(same, ["_s"], "_a").withColumn("_base", F.lit(0)), ["_s"], "_a")
    inside = same.join(first, ["_s", "_a"])
    second = cut(_running(inside, ["_s", "_a", "_base"], "_b"), ["_s", "_a"], "_b")
    inside = same.join(second, ["_s", "_a", "_b"])
    order = ["_key", "doc_id", "size", "_h"]
    # copies that tie are one row here, so a hot row does not fill the window
    by_key = Window.partitionBy("_s").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    nearer = F.col("_left") - F.col("_before") >= F.col("_end") - F.col("_left")
    last = (
        inside.groupBy("_s", "_base", *order)
        .agg(F.sum("size").alias("_sum"))
        .withColumn("_end", F.col("_base") + F.sum("_sum").over(by_key))
        .withColumn("_before", F.col("_end") - F.col("_sum"))
        .join(targets.select("_s", "_left"), "_s")
        .filter(F.col("_end") > F.col("_left"))
        .groupBy("_s")
        .agg(F.min(F.struct(*order, nearer.alias("near"))).alias("_last"))
    )
    cuts = stored(targets.join(last, "_s", "left").drop("source"), "mixing-cuts")
    mark = F.struct(*[F.col(f"_last.{c}") for c in order])
    here = F.struct(*order)
    chosen = F.col("_last").isNull() | (here < mark) | ((here == mark) & F.col("_last.near"))
    # nothing is left: no document is chosen, also if all have size 0
    chosen = chosen & (F.col("_left") > 0)
    times = F.col("_epochs") + chosen.cast("long")
    return (
        same.join(cuts, "_s")
        .withColumn("times", times)
        .select("doc_id", "source", "size", "source_size", "target", "times", (F.col("times") * F.col("size")).alias("taken"), F.col("_h").alias("text_hash"))
    )


def repeat_rows(docs: DataFrame, mixed: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The mixed corpus: each row of ``docs`` as often as the mix takes its document.

    Rows are told apart by id, source and text; those that agree in all three
    tie in the mix and are taken equally often.
    """
    times = mixed.filter("times > 0").select(
        F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("text_hash").alias("_h"), F.col("times").cast("int").alias("_times")
    )
    rows = packed(docs, id=F.col(f"`{doc_id}`"), source=F.col(f"`{source}`"), h=F.xxhash64(F.col(f"`{text}`")))
    same = F.col("id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("h") == F.col("_h"))
    taken = rows.join(times.distinct(), same)
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("_times")))).select("row.*")
