"""A Merkle manifest of a dataset: leaves, a tree per group, a tree over the groups, proofs.

A leaf is the SHA-256 of a row's fields, each with its length in front. The
leaves of a group are numbered in order; every run of ``arity`` consecutive
nodes has one parent, the digest of their hexadecimal digests, until one node is
left. The roots of the groups are the leaves of one more tree.

Numbering takes no window over a group: rows are laid out by ranges of (group,
order), each partition knows its rows' places, and the rows before it are summed
from a count per partition and group.

A level is built by equijoins of its nodes with themselves, one for each sibling
slot: the sibling of node ``i`` is ``i xor 1`` in a binary tree, else the nodes
at the other slot offsets of its run. That gives each node its left and right
siblings, which is what proofs need, and the nodes of slot zero emit the
parents. Levels are stored, so a lost executor costs one level at most. Proofs
go down again: a node's path is its own siblings and then the path of its
parent, one join for each level, so all joins together read about twice as many
nodes as there are leaves. Digests travel as 32 bytes.

Groups may be null (ordered first) and may hold any share of the rows. Order
columns may be null (first) or tied: ties are settled by the leaf, and rows equal
in that too are interchangeable. Null fields differ from empty ones. A group of
one row is its own root; an empty table gives no rows and no root. Columns are
picked by name, so others cannot clash.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aforo.llm.common import pick, stored

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
POSITION_BITS = 33
#: Joins of paths between two stored tables.
STORE_EVERY = 3


def text_of(digest: Column) -> Column:
    """Lowercase hexadecimal of a binary digest; empty for none."""
    return F.coalesce(F.lower(F.hex(digest)), F.lit(""))


def field(value: Column) -> Column:
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(values: Sequence[Column]) -> Column:
    """The digest of one row's fields, as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*[field(v) for v in values]), 256))


def numbered(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """Add ``idx``, each row's place in its group from 0, and store the rows.

    Sorted positions come from the number that Spark gives each row of a
    partition; the counts to add are one row per partition and group.
    """
    laid = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    laid = laid.withColumn("_at", F.monotonically_increasing_id())
    laid = laid.withColumns({"_p": F.shiftright("_at", POSITION_BITS), "_pos": F.col("_at").bitwiseAND(F.lit((1 << POSITION_BITS) - 1))})
    laid = stored(laid.drop("_at"), "merkle-order")
    parts = laid.groupBy(F.col("_p").alias("_part"), F.col(f"`{group}`").alias("_g")).agg(F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_g").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first"))
    same = (F.col("_p") == F.col("_part")) & F.col(f"`{group}`").eqNullSafe(F.col("_g"))
    placed = laid.join(parts.select("_part", "_g", "_before"), same)
    return placed.withColumn("idx", F.col("_pos") + F.col("_before")).drop("_p", "_pos", "_part", "_g", "_before")


def with_siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """Add ``left`` and ``right``, the digests beside each node in its run, and ``alone`` for the last node of a tree."""
    slot = F.col("idx") % arity
    out = nodes
    for offset in range(1, arity):
        at = F.col("idx").bitwiseXOR(F.lit(1)) if arity == 2 else F.col("idx") - slot + (slot + offset) % arity
        other = nodes.select(F.col("tree").alias("_tree"), F.col("idx").alias("_idx"), F.col("digest").alias(f"_s{offset}"))
        out = out.join(other, (F.col("tree") == F.col("_tree")) & (at == F.col("_idx")), "left").drop("_tree", "_idx")
    side = lambda rows: reduce(lambda a, b: F.concat(a, b), rows, F.lit(b""))
    found = {o: F.coalesce(F.col(f"_s{o}"), F.lit(b"")) for o in range(1, arity)}
    left = side([F.when(slot + o >= arity, found[o]).otherwise(F.lit(b"")) for o in found])
    right = side([F.when(slot + o < arity, found[o]).otherwise(F.lit(b"")) for o in found])
    out = out.withColumns({"left": left, "right": right}).drop(*[f"_s{o}" for o in found])
    return out.withColumn("alone", (F.col("idx") == 0) & (F.octet_length("right") == 0))


def climb(leaves: DataFrame, largest: int, arity: int = 2) -> tuple[list[DataFrame], DataFrame]:
    """Levels of the trees over ``leaves(tree, idx, digest, ...)`` and their roots ``(tree, digest)``.

    ``largest`` is the number of leaves of the largest tree. A tree ends at the
    level where its node is ``alone``.
    """
    levels = [stored(with_siblings(leaves, arity), "merkle-level")]
    while largest > 1:
        runs = levels[-1].filter((F.col("idx") % arity == 0) & ~F.col("alone"))
        digest = F.unhex(F.sha2(F.concat(text_of(F.col("digest")), text_of(F.col("right"))), 256))
        parents = runs.select("tree", F.expr(f"idx div {arity}").alias("idx"), digest.alias("digest"))
        levels.append(stored(with_siblings(parents, arity), "merkle-level"))
        largest = -(-largest // arity)
    roots = reduce(DataFrame.unionByName, [level.filter("alone").select("tree", "digest") for level in levels])
    return levels, roots


def descend(levels: list[DataFrame], above: DataFrame, arity: int = 2, carried: Sequence[str] = ()) -> DataFrame:
    """The leaves with ``path``, the siblings from each leaf to the end of the path that ``above(tree, path)`` continues."""
    step = F.array(F.struct("left", "right"))
    on_top = above.select(F.col("tree").alias("_tree"), F.col("path").alias("_path"), *carried)
    down = None
    for depth in reversed(range(len(levels))):
        level = levels[depth]
        extra = level.columns if depth == 0 else ["tree", "idx"]
        ended = level.filter("alone").join(on_top, F.col("tree") == F.col("_tree"))
        paths = ended.select(*extra, F.col("_path").alias("path"), *carried)
        if down is not None:
            upper = down.select(F.col("tree").alias("_tree"), F.col("idx").alias("_up"), F.col("path").alias("_path"), *carried)
            same = (F.col("tree") == F.col("_tree")) & (F.expr(f"idx div {arity}") == F.col("_up"))
            longer = level.filter(~F.col("alone")).join(upper, same)
            paths = paths.unionByName(longer.select(*extra, F.concat(step, "_path").alias("path"), *carried))
        down = stored(paths, "merkle-paths") if depth % STORE_EVERY == STORE_EVERY - 1 else paths
    return down


def proof_text(path: Column) -> Column:
    """All siblings of a path in order, hexadecimal."""
    return F.array_join(F.transform(path, lambda s: F.concat(text_of(s["left"]), text_of(s["right"]))), "")


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf's digest and its siblings give, hexadecimal."""
    up = lambda acc, s: F.sha2(F.concat(text_of(s["left"]), acc, text_of(s["right"])), 256)
    return F.aggregate(path, text_of(start), up)


def manifest(leaves: DataFrame, group: str, order: Sequence[str], arity: int = 2) -> DataFrame:
    """``leaves`` (with a binary ``leaf``) and each one's ``subroot``, ``root`` and ``path``.

    ``path`` holds ``(left, right)`` digests for every level, from the leaf through
    the group's root to the root of all.
    """
    if arity < 2:
        raise ValueError("a run has at least two slots")
    rows = numbered(leaves, group, [*order, "leaf"])
    sizes = stored(rows.groupBy(F.col(f"`{group}`").alias("name")).agg((F.max("idx") + 1).alias("n")), "merkle-groups")
    count, largest = sizes.agg(F.count(F.lit(1)), F.max("n")).first()
    trees = numbered(sizes.withColumn("_all", F.lit(0)), "_all", ["name"]).withColumnRenamed("idx", "tree")
    trees = stored(trees.drop("_all"), "merkle-trees")
    same = F.col(f"`{group}`").eqNullSafe(F.col("_name"))
    nodes = rows.join(trees.select(F.col("name").alias("_name"), "tree"), same).drop("_name").withColumnRenamed("leaf", "digest")
    levels, subroots = climb(nodes, largest or 0, arity)
    tops, root = climb(subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"), "digest"), count, arity)
    end = root.select("tree", F.expr("CAST(array() AS array<struct<left: binary, right: binary>>)").alias("path"), F.col("digest").alias("root"))
    above = descend(tops, end, arity, ["root"])
    above = above.select(F.col("idx").alias("tree"), "path", F.col("digest").alias("subroot"), "root")
    paths = descend(levels, stored(above, "merkle-subroots"), arity, ["subroot", "root"])
    return paths.drop("tree", "idx", "left", "right", "alone").withColumnRenamed("digest", "leaf")


def tampered_manifest(docs: DataFrame, arity: int = 2, every: int = 7) -> DataFrame:
    """Proofs of all documents, checked against rows of which some have one more in ``n_chars``.

    Rows whose crc32 of the id divides by ``every`` are tampered with; a row with
    a null id is not, and a null ``n_chars`` stays.
    """
    rows = pick(docs, **{c: c for c in FIELDS})
    touched = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % every == 0, F.lit(False))
    changed = [F.col("n_chars") + 1 if c == "n_chars" else F.col(c) for c in FIELDS]
    rows = rows.select(
        "doc_id",
        "lang",
        leaf([F.col(c) for c in FIELDS]).alias("leaf"),
        F.when(touched, leaf(changed)).alias("tampered"),
    )
    proofs = manifest(stored(rows, "merkle-leaves"), "lang", ["doc_id"], arity)
    folded = fold(F.coalesce("tampered", "leaf"), F.col("path"))
    found = proofs.select(
        "doc_id",
        text_of(F.col("leaf")).alias("leaf"),
        text_of(F.col("subroot")).alias("subroot"),
        text_of(F.col("root")).alias("root"),
        F.sha2(proof_text(F.col("path")), 256).alias("proof_sha256"),
        folded.alias("folded_root"),
    )
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
