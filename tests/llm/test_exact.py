"""Exact duplicates by chunk recipes against plain grouping."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from aforo.llm import exact

UPPER = {c: c + 32 for c in range(65, 91)}


def plain(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault((text or "").translate(UPPER), []).append(doc_id)
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        digest = hashlib.sha256(text.encode()).hexdigest()
        kept_one = False
        for i in ids:
            kept = i == keep and not kept_one
            kept_one = kept_one or kept
            out.append((i, keep, len(ids), kept, digest))
    return sorted(out, key=repr)


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghikoswÄß") for _ in range(rng.randrange(1, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    long = words(rng, 8000)
    texts = [words(rng, rng.randrange(400)) for _ in range(60)]
    texts += [t.upper().replace("Ä", "ä") for t in texts[:20]] + [long, long.swapcase(), long + "x", "x" + long, None, "", " ", "Ä", "ä", "\n"]
    texts += ["z" * 10_000, "z" * 10_001, "漢字" * 5_000, "漢字" * 5_000]
    out = [(i if i % 9 else None, t) for i, t in enumerate(texts)]
    return out + out[:10] + [(None, texts[0])] * 3


def got(df, **options):
    return sorted(map(tuple, exact.exact_duplicates(df, **options).collect()), key=repr)


def test_groups_as_by_plain_python(documents, rows):
    assert got(documents(rows)) == plain(rows)


def test_shared_identifiers_are_found_and_replaced(documents, rows):
    df = documents(rows)
    weak = F.length
    assert not exact.ambiguous(exact.chunk_store(df, identify=weak)).isEmpty()
    assert got(df, identifiers=(weak, exact.two_hashes)) == plain(rows)
    with pytest.raises(ValueError, match="share"):
        exact.verified_identifier(df, identifiers=(weak,))


def test_chunks_make_up_the_text_and_fall_in_step(spark):
    rng = random.Random(4)
    passage, other = words(rng, 6000).lower(), words(rng, 700).lower()
    texts = [passage, other + passage, "漢" * 9000, "\U0001f600\n" * 6000, "", "a"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    cut = [r[0] for r in df.select(exact.chunks(F.col("t"))).collect()]
    assert ["".join(c) for c in cut] == texts
    assert all(len(c) <= exact.MOST for row in cut for c in row) and [len(c) for c in cut[2]] == [4096, 4096, 808]
    assert all(len(c) >= exact.LEAST for c in cut[0][:-1])
    assert len(set(cut[0]) & set(cut[1])) > 0.8 * len(cut[0])


def test_store_and_recipes_give_the_texts_back(documents, rows):
    df = documents(rows)
    store = {tuple(r.id): r.chunk for r in exact.chunk_store(df).collect()}
    back = sorted("".join(store[tuple(i)] for i in r.recipe) for r in exact.recipes(df, exact.two_hashes).collect())
    assert back == sorted((t or "").translate(UPPER) for _, t in rows)


def test_empty_table_and_text_ids(spark):
    df = spark.createDataFrame([], "doc_id long, text string, recipe string, row int")
    assert got(df) == []
    df = spark.createDataFrame([("b", "T", 1), ("a", "t", 2)], "doc_id string, text string, kept int")
    assert [r[:4] for r in got(df)] == [("a", "b", 2, False), ("b", "b", 2, True)]
