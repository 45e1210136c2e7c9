"""Exact duplicates by content-defined chunk recipes.

Texts are equal when identical after lower-casing A-Z. A text is cut where its
own characters say so: at least ``LEAST`` characters, then on to the first place
whose last three code points are all 3 modulo 4 (in running text one place in
some 600), at most ``MOST`` characters. Where a text repeats a passage of
another, the cuts fall in step again soon after its start. Code points above
U+00FF never cut by themselves, so other scripts get chunks of ``MOST``.

Each chunk gets an identifier. Every distinct pair of identifier and chunk is
shuffled once, and an identifier that stands for two chunks rejects the whole
scheme: the next one of ``IDENTIFIERS`` is tried, and the last failing is an
error. After that a text is its recipe, the ordered list of verified
identifiers: equal recipes mean equal texts, and only recipes, some two per cent
of the characters, are grouped, joined and stored.

The row with the largest id of a group stays; of several such rows, the last as
stored. Null ids are least, so they stay only in a group that has no other.
Null texts count as empty and all empty texts are equal, by an empty recipe.
Repeated rows are rows each, of which one stays. Very long texts are more chunks.
An empty table gives no rows. Columns are picked by name, so others cannot clash.

A group may hold a third of all rows: it is counted with partial sums, and rows
find their group by a join whose large partitions AQE splits. Everything is
DataFrame functions.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aforo.llm.common import ascii_lower, pick, stored

LEAST, MOST = 256, 4096
#: Code points that are 3 modulo 4, up to U+00FF: a class of these is one bit set.
CUTTING = "".join(re.escape(chr(c)) for c in range(0x23, 0x100, 4))
CHUNK = rf"(?s).{{{LEAST - 3},{MOST - 3}}}?(?:[{CUTTING}]{{3}}|\z)|.{{1,{MOST}}}"

Identifier = Callable[[Column], Column]


def two_hashes(chunk: Column) -> Column:
    """128 bits: the hash of the chunk, and of the chunk behind a mark."""
    return F.struct(F.xxhash64(chunk).alias("a"), F.xxhash64(F.lit("second"), chunk).alias("b"))


#: Tried in this order, until no identifier stands for two chunks.
IDENTIFIERS: Sequence[Identifier] = (two_hashes, lambda chunk: F.sha2(chunk, 256))


def normalised(text: Column) -> Column:
    return ascii_lower(F.coalesce(text, F.lit("")))


def chunks(text: Column) -> Column:
    """The chunks of a normalised text, in order; together they are the text."""
    return F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))


def chunk_store(docs: DataFrame, text: str = "text", identify: Identifier = two_hashes) -> DataFrame:
    """``(id, chunk)``, one row for each distinct chunk of all texts."""
    pieces = pick(docs, text=text).select(F.explode(chunks(normalised(F.col("text")))).alias("chunk"))
    # partial distinct: a chunk that many texts share leaves a task once
    return pieces.select(identify(F.col("chunk")).alias("id"), "chunk").distinct()


def ambiguous(store: DataFrame) -> DataFrame:
    """Identifiers that stand for more than one chunk."""
    return store.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id")


def verified_identifier(docs: DataFrame, text: str = "text", identifiers: Sequence[Identifier] = IDENTIFIERS) -> Identifier:
    """The first identifier that tells all chunks of these texts apart."""
    for identify in identifiers:
        if ambiguous(chunk_store(docs, text, identify)).isEmpty():
            return identify
    raise ValueError("different chunks share every identifier")


def recipes(docs: DataFrame, identify: Identifier, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(row, doc_id, recipe, text_sha256)``, stored; ``row`` numbers the rows, with gaps."""
    rows = pick(docs, doc_id=doc_id, text=text).withColumn("_t", normalised(F.col("text")))
    rows = rows.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        F.transform(chunks(F.col("_t")), identify).alias("recipe"),
        F.sha2("_t", 256).alias("text_sha256"),
    )
    return stored(rows, "exact-recipes")


def exact_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", identifiers: Sequence[Identifier] = IDENTIFIERS
) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)`` for every row."""
    rows = recipes(docs, verified_identifier(docs, text, identifiers), doc_id, text)
    # by (recipe, id) first: what is left per group are its distinct ids
    ids = rows.groupBy("recipe", "doc_id").agg(F.max("row").alias("last"), F.count(F.lit(1)).alias("n"))
    largest = F.struct(F.col("doc_id"), F.col("last"))
    groups = ids.groupBy(F.col("recipe").alias("_recipe")).agg(F.max(largest).alias("_keep"), F.sum("n").alias("group_size"))
    # stored, so that the join reads two plain exchanges and large partitions can be split
    groups = stored(groups, "exact-groups")
    return rows.join(groups, F.col("recipe") == F.col("_recipe")).select(
        "doc_id",
        F.col("_keep.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("_keep.last")).alias("kept"),
        "text_sha256",
    )
