"""Near copies of five-word shingles against brute force."""

import random

import numpy as np

from aforo.llm import simhash


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def jaccard(a, b):
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y)


def prose(rng, n):
    return [f"w{rng.randrange(3000)}" for _ in range(n)]


def edited(rng, words, share):
    """About ``share`` of the words replaced, one by one or as one run."""
    out, n = list(words), max(1, int(len(words) * share))
    if rng.random() < 0.5:
        for i in rng.sample(range(len(out)), n):
            out[i] = f"x{rng.randrange(10**6)}"
    else:
        at = rng.randrange(len(out) - n)
        out[at : at + n] = prose(rng, n)
    return out


def test_votes_are_those_of_a_plain_loop():
    text = " ".join(prose(random.Random(3), 900))
    got = simhash.wide_fingerprint(text)
    assert got.dtype == np.uint64 and len(got) == simhash.WIDE
    parts = [simhash.wide_fingerprint(" ".join(w)) for w in shingles(text)]
    bits = np.unpackbits(np.array(parts).astype("<u8").view(np.uint8), axis=1, bitorder="little").astype(int).sum(axis=0)
    assert (np.packbits(bits * 2 > len(parts), bitorder="little").view("<u8") == got).all()


def test_near_copies_are_found_and_others_left_alone(spark, documents):
    rng = random.Random(11)
    rows, near, far = [], [], []
    for i in range(300):
        base = prose(rng, rng.choice([60, 150, 600]))
        other = edited(rng, base, rng.choice([0.005, 0.01, 0.02, 0.1, 0.3]))
        a, b = " ".join(base), " ".join(other)
        rows += [(2 * i, a), (2 * i + 1, b)]
        s = jaccard(a, b)
        if s >= 0.8:
            near.append((2 * i, s))
        elif s < 0.65:
            far.append(2 * i)
    got = {r.doc_id: r.component_id for r in simhash.near_copies(documents(rows)).collect()}
    found = sum(got[d] == got[d + 1] for d, _ in near)
    assert len(near) > 80 and found >= 0.9 * len(near)
    assert len(far) > 40 and all(got[d] != got[d + 1] for d in far)
    assert all(got[d] // 2 == d // 2 for d in got)


def test_a_large_group_becomes_one(spark, documents):
    """Far more members than a window holds, all of different texts."""
    rng = random.Random(5)
    base = prose(rng, 400)
    rows = [(i, " ".join(edited(rng, base, 0.005))) for i in range(400)]
    rows += [(1000 + i, " ".join(prose(rng, 100))) for i in range(50)]
    got = [r for r in simhash.near_copies(documents(rows)).collect()]
    assert sum(r.component_id == 0 for r in got if r.doc_id < 400) >= 398
    assert all(r.component_id == r.doc_id for r in got if r.doc_id >= 1000)


def test_candidates_of_small_groups_are_complete_across_batches():
    rng = np.random.default_rng(2)
    key = np.sort(rng.integers(0, 40, 200)).astype(np.int32)
    fp = np.zeros(200, np.uint64)
    fp[:] = np.arange(200)
    want = {(i, j) for i in range(200) for j in range(i + 1, 200) if key[i] == key[j]}
    assert max(np.bincount(key)) <= simhash.WINDOW + 1
    got = set()
    for size in (200, 7, 30):
        got, old_key, old_fp = set(), key[:0], fp[:0]
        for at in range(0, 200, size):
            old = len(old_key)
            k, f = np.concatenate([old_key, key[at : at + size]]), np.concatenate([old_fp, fp[at : at + size]])
            a, b = simhash._neighbours(k, f, old)
            got |= set(zip(f[a].tolist(), f[b].tolist(), strict=True))
            old_key, old_fp = k[-simhash.WINDOW :], f[-simhash.WINDOW :]
        assert got == want


def test_edges(spark, documents):
    rows = [(1, "A b c d e f"), (2, "a B c d e f"), (2, "a B c d e f"), (3, None), (4, ""), (6, "one"), (None, "x y z"), (None, "x y z")]
    got = {(r.doc_id, r.component_id) for r in simhash.near_copies(documents(rows)).collect()}
    assert got == {(1, 1), (2, 1), (3, 3), (4, 3), (6, 6), (None, None)}
    assert simhash.near_copies(documents([(1, "a")]).limit(0)).count() == 0


def test_pairs_meet_their_texts_in_cells(spark, monkeypatch):
    """A family of pairs without links repeats no text for each pair, and none of its links is lost."""
    monkeypatch.setattr(simhash, "PARTS", 3, raising=False)
    rng = random.Random(21)
    base = prose(rng, 300)
    texts = [" ".join([*base[: 300 - n], *prose(rng, n)]) for n in [40] * 60 + [5] * 30]
    wide = [[int(w) for w in simhash.wide_fingerprint(t).view(np.int64)] for t in texts]
    rows = spark.createDataFrame(list(zip(range(90), wide, texts, strict=True)), "node long, wide array<long>, t string")
    pairs = spark.createDataFrame([(a, b) for a in range(90) for b in range(a + 1, 90)], "a long, b long")
    found = simhash.similar_pairs(pairs, simhash.shingle_sets(rows, 5), 0.8)
    got = [(r.a, r.b) for r in found.collect()]
    near = np.bitwise_count(np.array(wide).view(np.uint64)[:, None] ^ np.array(wide).view(np.uint64)).sum(axis=2) <= simhash.NEAR_BITS
    want = {(a, b) for a in range(90) for b in range(a + 1, 90) if near[a, b] and jaccard(texts[a], texts[b]) >= 0.8}
    assert set(got) <= want and len(got) < len(want)
    root = list(range(90))
    for a, b in got:
        root = [root[a] if r == root[b] else r for r in root]
    assert all(root[a] == root[b] for a, b in want)
    assert "Join [a#" not in found._jdf.queryExecution().toString()
