"""SimHash against plain loops."""

import random

import numpy as np
import pytest

from aforo.llm import simhash


def exact(fps):
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in fps:
        for b in fps:
            if (a ^ b).bit_count() <= 2:
                parent[find(max(a, b))] = find(min(a, b))
    return {f: find(f) for f in fps}


def cluster(seed, groups, size):
    rng, out = random.Random(seed), set()
    for _ in range(groups):
        at = rng.getrandbits(64)
        for _ in range(size):
            out.add(at)
            for _ in range(rng.randint(1, 3)):
                at ^= 1 << rng.randrange(64)
    return sorted(out)


def test_every_pair_within_two_bits_of_a_segment_shares_a_codeword():
    errors = simhash.golay_errors()
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 23, 300)
    for flips in ([0], [3, 17], [22, 1]):
        b = a ^ sum(1 << f for f in flips)
        na, nb = simhash.codeword_numbers(a, errors), simhash.codeword_numbers(b, errors)
        assert all(set(x) & set(y) for x, y in zip(na, nb))
    assert {len(set(x)) for x in simhash.codeword_numbers(a, errors)} == {1, 6}


@pytest.mark.parametrize("bucket", [256, 3])
def test_links_reach_what_brute_force_reaches(spark, bucket):
    fps = cluster(5, 12, 20)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    nodes = spark.createDataFrame([(f,) for f in signed], "fp long")
    got = {}
    from aforo.llm.graph import components

    for node, root in components(simhash.near_links(nodes, bucket)).collect():
        got.setdefault(root, set()).add(node % (1 << 64))
    want = {}
    for f, r in exact(fps).items():
        want.setdefault(r, set()).add(f)
    assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


def test_edge_cases(spark, documents):
    long = "word " * 50_000
    rows = [(1, "A b c d"), (2, "a B c d"), (2, "a B c d"), (3, None), (4, ""), (5, " \t"), (6, "one"), (None, "x y z"), (8, long)]
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(documents(rows)).collect()}
    by = {}
    for d, f, c in got:
        by.setdefault(d, (f, c))
    assert by[1][0] == by[2][0] and by[2][1] == 1
    assert by[3] == by[4] == by[5] == ("0" * 16, 3)
    assert by[None][1] is None and len(by) == 8
    kept = simhash.keep_one(documents(rows))
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3, 6, 8] and "key" in kept.columns
    assert simhash.near_duplicates(documents([(1, "a")]).limit(0)).count() == 0
