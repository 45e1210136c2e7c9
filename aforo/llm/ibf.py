"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text is cut into units (lines, and sentences in them), each unit hashed to 64
bits, and every digest added to one cell of each of three ranges. A cell holds a
count, the xor of its digests and the xor of their checks. Subtracting two
sketches leaves the cells of the digests that differ. A cell with count 1 or -1
and a fitting check gives one of them away; taking it out of its other cells
("peeling") gives more, until all are recovered or the sketch was too small.

The fingerprint is a sketch of ``3 * 8`` cells. If its difference cannot be
peeled, the retry deals the digests of both texts to as many small sketches as
their number asks for, and a small sketch that fails is built again four times
larger, twice. What still fails (equal cells by chance) is counted from the
digests. Likeness is the Dice share of common digests, 1 for two empty texts.

Everything is a DataFrame expression over one row; cost grows with the number
of digests. Units that repeat in a text count once. Null or blank texts have an
empty sketch. Any table size works; an empty one gives no rows.

:func:`with_next` finds the next document in descending id. Ids are cut into
buckets of even size at quantiles; a bucket also gets the first row of the
bucket below it, so one shuffle brings neighbours together and no window spans
the table. Null ids come last; rows of one id are ordered by a hash of the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aforo.llm.common import pick

UNIT_END = r"(?<=[.!?])[ \t]+|[\r\n]+"
SUB = 8
PER_SKETCH = 12
ROUNDS = 16
BUCKET_CHARS = 2 << 20
MOST_BUCKETS = 1 << 17


def digests(text: Column) -> Column:
    """The distinct 64-bit digests of a text's units."""
    units = F.filter(F.transform(F.split(text, UNIT_END), lambda u: F.trim(u)), lambda u: u != "")
    return F.array_distinct(F.transform(units, lambda u: F.xxhash64(u)))


def _long(value: int) -> Column:
    return F.lit(value).cast("long")


def _cell(n: Column, k: Column, c: Column) -> Column:
    return F.struct(n.alias("n"), k.alias("k"), c.alias("c"))


def _check(key: Column) -> Column:
    return F.xxhash64(key).bitwiseAND(_long(0xFFFFFFFF))


def _element(key: Column, sign: Column, sub: int, shift: int) -> Column:
    """A digest with its sign, check and the number of its cell in each range."""
    bits = sub.bit_length() - 1
    at = [F.shiftrightunsigned(key, shift + bits * j).bitwiseAND(_long(sub - 1)) + sub * j for j in range(3)]
    return F.struct(key.alias("k"), sign.alias("n"), _check(key).alias("c"), F.array(*at).alias("at"))


def _fold(elements: Column, start: Column, i: Column, sub: int, sign: int) -> Column:
    """``start`` with the elements of cell ``i`` added (sign 1) or taken out (-1)."""
    part = F.shiftright(i, sub.bit_length() - 1).cast("int")
    own = F.filter(elements, lambda e: F.get(e["at"], part) == i)
    return F.aggregate(
        own,
        start,
        lambda acc, e: _cell(acc["n"] + e["n"] * sign, acc["k"].bitwiseXOR(e["k"]), acc["c"].bitwiseXOR(e["c"])),
    )


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), body)[0]


def cells(keys: Column, sub: int = SUB, shift: int = 30, minus: Column | None = None) -> Column:
    """The cells of a sketch of ``keys``, less those of a sketch of ``minus``."""
    one = _long(1)
    elements = F.transform(keys, lambda k: _element(k, one, sub, shift))
    if minus is not None:
        elements = F.concat(elements, F.transform(minus, lambda k: _element(k, -one, sub, shift)))
    zero = _cell(_long(0), _long(0), _long(0))
    numbers = F.sequence(_long(0), _long(3 * sub - 1))
    return _let(elements, lambda e: F.transform(numbers, lambda i: _fold(e, zero, i, sub, 1)))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda p, q: _cell(p["n"] - q["n"], p["k"].bitwiseXOR(q["k"]), p["c"].bitwiseXOR(q["c"])))


def peel(difference: Column, sub: int = SUB, shift: int = 30) -> Column:
    """Number of digests recovered from the cells of a difference; null if some stay hidden."""

    def pure(rows: Column) -> Column:
        alone = F.filter(rows, lambda x: (F.abs(x["n"]) == 1) & (_check(x["k"]) == x["c"]))
        return F.array_distinct(F.transform(alone, lambda x: _element(x["k"], x["n"], sub, shift)))

    def step(state: Column, _: Column) -> Column:
        def without(p: Column) -> Column:
            rest = F.transform(state["cells"], lambda x, i: _fold(p, x, i.cast("long"), sub, -1))
            return F.struct(rest.alias("cells"), (state["found"] + F.size(p)).alias("found"), (F.size(p) == 0).alias("done"))

        return F.when(state["done"], state).otherwise(_let(pure(state["cells"]), without))

    start = F.struct(difference.alias("cells"), F.lit(0).alias("found"), F.lit(False).alias("done"))
    clean = lambda s: ~F.exists(s["cells"], lambda x: (x["n"] != 0) | (x["k"] != 0))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda s: F.when(clean(s), s["found"]))


def difference_size(a: Column, b: Column, cells_a: Column, cells_b: Column) -> Column:
    """How many digests of ``a`` and ``b`` differ: by their sketches, else by larger ones."""
    exact = lambda x, y: F.size(F.array_except(x, y)) + F.size(F.array_except(y, x))

    def bucket(x: Column, y: Column) -> Column:
        sizes = ((SUB, 30), (4 * SUB, 34), (16 * SUB, 40))
        tries = [peel(cells(x, sub, shift, minus=y), sub, shift) for sub, shift in sizes]
        return F.when(F.size(x) + F.size(y) == 0, 0).otherwise(F.coalesce(*tries, exact(x, y)))

    def bound_bucket(x: Column, y: Column) -> Column:
        return _let(F.struct(x.alias("x"), y.alias("y")), lambda p: bucket(p["x"], p["y"]))

    n = F.size(a) + F.size(b)
    power = F.ceil(F.log2(F.greatest(n / PER_SKETCH, F.lit(1.0)))).cast("int")
    many = F.pow(F.lit(2.0), power).cast("long")

    def own(keys: Column, i: Column, of: Column) -> Column:
        return F.filter(keys, lambda k: F.pmod(k, of) == i)

    def dealt(m: Column) -> Column:
        """In two steps, by the lowest bits and then by all, so that long texts are not read once per sketch."""

        def split(low: Column) -> Column:
            def part(i: Column) -> Column:
                both = F.struct(own(a, i, low).alias("x"), own(b, i, low).alias("y"))
                numbers = F.sequence(i, m - 1, low)
                return _let(both, lambda p: total(F.transform(numbers, lambda j: bound_bucket(own(p["x"], j, m), own(p["y"], j, m)))))

            return total(F.transform(F.sequence(_long(0), low - 1), part))

        return _let(F.pow(F.lit(2.0), F.floor(F.log2(m) / 2)).cast("long"), split)

    def total(parts: Column) -> Column:
        return F.aggregate(parts, F.lit(0), lambda s, d: s + d)

    # more digests than cells cannot be peeled, so their number is looked at first
    first = F.when(F.abs(F.size(a) - F.size(b)) <= 3 * SUB, peel(subtract(cells_a, cells_b)))
    return F.coalesce(first, _let(many, dealt))


def likeness(a: Column, b: Column, cells_a: Column, cells_b: Column) -> Column:
    n = F.size(a) + F.size(b)
    return F.when(n == 0, 1.0).otherwise((n - difference_size(a, b, cells_a, cells_b)) / n)


def fingerprint(sketch: Column) -> Column:
    """The cells as text: count, digests and checks in hexadecimal."""
    return F.array_join(F.transform(sketch, lambda x: F.concat_ws(".", F.hex(x["n"]), F.hex(x["k"]), F.hex(x["c"]))), ",")


def _bucket(bounds: list[int]) -> Column:
    """Number of bounds at or below the id, by binary search; -1 for null."""
    steps = max(1, len(bounds).bit_length())
    padded = F.array(*[_long(b) for b in bounds]) if bounds else F.array().cast("array<bigint>")
    widths = F.array(*[F.lit(1 << (steps - 1 - i)) for i in range(steps)])
    take = lambda at, w: (at + w <= len(bounds)) & (F.get(padded, at + w - 1) <= F.col("doc_id"))
    found = F.aggregate(widths, F.lit(0), lambda at, w: F.when(take(at, w), at + w).otherwise(at))
    return F.when(F.col("doc_id").isNull(), -1).otherwise(found)


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """Add ``next_<column>`` of the row after each in descending ``doc_id``; after the last comes the first.

    ``docs`` has ``doc_id``, ``h`` and the columns. The driver sees the bounds
    and a row per bucket, at most ``MOST_BUCKETS``.
    """
    sizes = docs.agg(F.sum(F.length("text") + 1), F.count(F.lit(1))).first()
    buckets = min(MOST_BUCKETS, max(1, -(-(sizes[0] or 0) // BUCKET_CHARS), min(sizes[1], int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
    share = [i / buckets for i in range(1, buckets)]
    bounds = sorted({int(b) for b in docs.approxQuantile("doc_id", share, 1 / (8 * buckets))}) if share else []
    rows = docs.withColumn("_b", _bucket(bounds))
    # first row of each bucket in descending order
    first = F.max_by(F.struct("doc_id", "h"), F.struct("doc_id", -F.col("h")))
    heads = {r["_b"]: r["f"] for r in rows.groupBy("_b").agg(first.alias("f")).collect()}
    order = sorted(heads, reverse=True)
    ghosts = [(heads[after]["doc_id"], heads[after]["h"], b) for b, after in zip(order, order[1:] + order[:1], strict=True)]
    guide = docs.sparkSession.createDataFrame(ghosts, "_id long, _h long, _to int")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h"))
    copies = docs.join(F.broadcast(guide), same).select(*docs.columns, F.col("_to").alias("_b"), F.lit(True).alias("_ghost"))
    both = rows.withColumn("_ghost", F.lit(False)).unionByName(copies)
    order = Window.partitionBy("_b").orderBy("_ghost", F.col("doc_id").desc_nulls_last(), "h")
    followed = both.withColumns({f"next_{c}": F.lead(c).over(order) for c in columns})
    return followed.filter(~F.col("_ghost")).drop("_b", "_ghost")


def edited_fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every document and of its edited text, and how near they are.

    The edited text keeps the first half; its last ``n_chars / 2`` code points
    are replaced by the first of the next document.
    """
    rows = pick(docs, doc_id=doc_id, text=text)
    rows = rows.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    rows = with_next(rows, ["text"])
    n = F.length("text").cast("long")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n.cast("int") - half), F.substring("next_text", F.lit(1), half))
    rows = rows.select("doc_id", n.alias("n_chars"), edited.alias("edited"), "text", "next_text")
    rows = rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        digests(F.col("text")).alias("a"), digests(F.col("edited")).alias("e"), digests(F.col("next_text")).alias("x"),
    )
    rows = rows.withColumns({f"c{k}": cells(F.col(k)) for k in "aex"})
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprint(F.col("ca")).alias("fingerprint"),
        fingerprint(F.col("ce")).alias("edited_fingerprint"),
        likeness(F.col("a"), F.col("e"), F.col("ca"), F.col("ce")).alias("near_edited"),
        likeness(F.col("a"), F.col("x"), F.col("ca"), F.col("cx")).alias("near_next"),
    )
