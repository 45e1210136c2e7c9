"""The Merkle manifest against a plain tree in Python."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from aforo.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, idx string, tree int, path string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(doc_id, source, lang, n_chars, text):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def plain_tree(nodes, arity):
    """The root, and per leaf the (left, right) siblings of each level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for path, i in zip(paths, at, strict=True):
            run = i - i % arity
            path.append(("".join(nodes[run:i]), "".join(nodes[i + 1 : run + arity])))
        nodes = [h(*nodes[i : i + arity]) for i in range(0, len(nodes), arity)]
        at = [i // arity for i in at]
    return nodes[0], paths


def plain_manifest(rows, arity):
    groups = {}
    for doc_id, text, lang, source, n in rows:
        touched = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0
        forged = plain_leaf(doc_id, source, lang, n + 1 if touched and n is not None else n, text)
        groups.setdefault(lang, []).append((doc_id, plain_leaf(doc_id, source, lang, n, text), forged))
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    for g in groups.values():
        g.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    trees = {name: plain_tree([r[1] for r in groups[name]], arity) for name in names}
    root, tops = plain_tree([trees[n][0] for n in names], arity)
    out = []
    for name, top in zip(names, tops, strict=True):
        for (doc_id, leaf, forged), path in zip(groups[name], trees[name][1], strict=True):
            folded = forged
            for left, right in path + top:
                folded = h(left, folded, right)
            out.append((doc_id, leaf, trees[name][0], root, h(*[a + b for a, b in path + top]), folded, folded == root))
    return sorted(out, key=repr)


def make(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    out = []
    for lang, n in (("en", 83), (None, 5), ("", 1), ("é", 16), ("z", 2), ("ŝ", 3)):
        for _ in range(n):
            i = rng.randrange(10_000)
            out.append((i, rng.choice([None, "", "text ß", "long " * 9000]), lang, rng.choice([None, "s", "-"]), rng.choice([None, i])))
    return out + [out[0], out[0], (None, "a", "en", None, 1), (None, "b", "en", None, 1), (7, "a", "en", "s", 1), (7, "b", "en", "s", 1)]


@pytest.mark.parametrize("arity", [2, 3, 5])
def test_manifest_as_by_plain_python(spark, rows, arity):
    got = sorted(map(tuple, merkle.tampered_manifest(make(spark, rows), arity).collect()), key=repr)
    assert got == plain_manifest(rows, arity)
    assert {r[6] for r in got} == {True, False}


@pytest.mark.parametrize("rows", [[], [(1, "t", None, "s", 3)], [(1, "t", "a", "s", 3), (2, "t", "b", "s", 3)]])
def test_small_tables(spark, rows):
    got = sorted(map(tuple, merkle.tampered_manifest(make(spark, rows)).collect()), key=repr)
    assert got == (plain_manifest(rows, 2) if rows else [])


def test_numbers_are_places_in_the_group(spark):
    rng = random.Random(12)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, *range(40)]), i) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, v long, row long").repartition(7)
    got = merkle.numbered(df, "g", ["v", "row"]).collect()
    for g in ("a", "b", None):
        mine = sorted((r for r in got if r.g == g), key=lambda r: r.idx)
        assert [r.idx for r in mine] == list(range(len(mine)))
        assert [(r.v, r.row) for r in mine] == sorted(((r[1], r[2]) for r in rows if r[0] == g), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))


def test_a_run_has_two_slots_at_least(spark):
    leaves = spark.createDataFrame([("a", 1)], "g string, v long").withColumn("leaf", F.unhex(F.sha2("g", 256)))
    with pytest.raises(ValueError, match="two slots"):
        merkle.manifest(leaves, "g", ["v"], 1)
