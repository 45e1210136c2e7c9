"""Near copies in groups far larger than a window, against brute force."""

import random

import numpy as np
from test_near_copies import jaccard, prose, shingles

from aforo.llm import simhash


def classes_of(texts, similar=0.8):
    """Least index of each text's component; all pairs compared that share a key and are near enough in bits."""
    wide = np.array([simhash.wide_fingerprint(t) for t in texts])
    rows, keys = simhash.pair_keys(wide)
    own = [set() for _ in texts]
    for r, k in zip(rows.tolist(), keys.tolist(), strict=True):
        own[r].add(k)
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        bits = np.bitwise_count(wide[:i] ^ wide[i])
        for j in np.flatnonzero((bits[:, 0] <= simhash.FIRST_BITS) & (bits.sum(axis=1) <= simhash.NEAR_BITS)).tolist():
            common = len(a & sets[j])
            if common >= similar * (len(a) + len(sets[j]) - common) and own[i] & own[j]:
                low, high = sorted((find(i), find(j)))
                root[high] = low
    return [find(i) for i in range(len(texts))]


def ending(rng, words, n):
    """``words`` with other ``n`` last words."""
    return " ".join([*words[: len(words) - n], *prose(rng, n)])


def test_two_dense_groups_become_one(spark, documents):
    """Each text's nearest are all of its own group; the groups resemble each other at 0.85."""
    rng = random.Random(8)
    base = prose(rng, 600)
    other = [*prose(rng, 46), *base[46:]]
    texts = [ending(rng, words, 1) for words in (base, other) for _ in range(120)]
    assert 0.83 < jaccard(texts[0], texts[200]) < 0.87
    got = {r.doc_id: r.component_id for r in simhash.near_copies(documents(list(enumerate(texts)))).collect()}
    assert set(got.values()) == {0}


def test_partners_in_a_template_family(spark, documents):
    """Hundreds share a template at some 0.7 and are no copies; some have a partner at 0.8 to 0.85 among them."""
    rng = random.Random(9)
    template, texts = prose(rng, 500), []
    for i in range(260):
        own = prose(rng, 90)
        texts.append(" ".join([*template, *own]))
        if i % 4 == 0:
            texts.append(" ".join([*template, *own[:46], *prose(rng, 44)]))
    want = classes_of(texts)
    got = {r.doc_id: r.component_id for r in simhash.near_copies(documents(list(enumerate(texts)))).collect()}
    partners = [i for i, r in enumerate(want) if r != i]
    assert len(partners) > 50 and all(got[i] == got[want[i]] for i in partners)


def test_all_pairs_of_different_roots_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 7)
    rng = np.random.default_rng(4)
    rows = [(int(k), i, int(rng.integers(0, 2**20))) for i, k in enumerate(np.sort(rng.integers(0, 4, 160)))]
    large = spark.createDataFrame(rows, "key int, node long, fp long").repartition(5)
    labels = spark.createDataFrame([(i, i % 9) for _, i, _ in rows if i % 3], "node long, root long")
    root = {i: i % 9 if i % 3 else i for _, i, _ in rows}
    want = {
        (i, j): (x ^ y).bit_count()
        for k, i, x in rows
        for m, j, y in rows
        if i < j and k == m and root[i] != root[j] and (x ^ y).bit_count() <= simhash.FIRST_BITS
    }
    got = [(r.a, r.b) for r in simhash.unjoined_pairs(large, labels, nearest=False).collect()]
    assert sorted(got) == sorted(want)
    few = {(r.a, r.b) for r in simhash.unjoined_pairs(large, labels, nearest=True).collect()}
    key = {i: k for k, i, _ in rows}
    best = {}
    for (i, j), bits in want.items():
        of = (key[i], *sorted((root[i], root[j])))
        best[of] = min(best.get(of, 65), bits)
    assert few <= set(want) and len(few) < len(want)
    found = {}
    for i, j in few:
        of = (key[i], *sorted((root[i], root[j])))
        found[of] = min(found.get(of, 65), want[i, j])
    assert found == best


def test_no_link_without_its_shingles(spark, documents):
    """A family at some 0.78, of whose many pairs some are near in bits by chance."""
    rng = random.Random(12)
    base = prose(rng, 300)
    texts = [ending(rng, base, 36) for _ in range(180)]
    wide = np.array([simhash.wide_fingerprint(t) for t in texts])
    apart = np.bitwise_count(wide[:, None] ^ wide).sum(axis=2)
    assert (apart[np.triu_indices(180, 1)] <= simhash.SURE_BITS).any()
    want = classes_of(texts)
    got = {r.doc_id: r.component_id for r in simhash.near_copies(documents(list(enumerate(texts)))).collect()}
    assert [got[i] for i in range(180)] == want == list(range(180))


def test_one_stays_of_each_group_whatever_its_ids(spark, documents):
    """Unrelated texts without ids or with the same id are groups of their own."""
    copy = "x y z u v w"
    rows = [(None, "a b c d e f"), (None, "g h i j k l"), (None, "G h i j k l"), (5, "m n o p q r"), (5, "s t u v w x")]
    rows += [(None, copy), (7, copy), (9, copy.upper()), (7, copy)]
    got = [(r.doc_id, (r.text or "").lower()) for r in simhash.keep_one(documents(rows)).collect()]
    want = [(None, "a b c d e f"), (None, "g h i j k l"), (5, "m n o p q r"), (5, "s t u v w x"), (7, copy)]
    assert sorted(got, key=str) == sorted(want, key=str)
