"""Near duplicates by 64-bit SimHash, found with Golay-code keys.

A fingerprint is cut into segments of 23, 23 and 18 bits. The binary Golay code
of length 23 is perfect: every word lies within 3 bits of just one of its 4,096
codewords. A segment and its 23 one-bit neighbours decode to 1 or 6 different
codeword numbers, and two segments at most 2 bits apart share one of them, since
the word between them is a neighbour of both.

Of at most 2 differing bits, by the pigeonhole, one segment has none. Keys are
that segment as it is with a codeword number of the next one: some 16 keys of
30 to 35 bits for a fingerprint, and none of the linked pairs is missed. Pairs
that share a key are verified by counting the differing bits.

Documents of one fingerprint are one node, however many. Keys shared by more
than ``BUCKET`` fingerprints are not paired: their members give the 65 words
within 1 bit of them, and any two fingerprints with such a word in common are at
most 2 bits apart, so every word links its (at most 65) members by a star. That
path is exact too and linear in the members.

:func:`near_copies` serves a wider similarity, a Jaccard coefficient of five-word
shingles of 0.8 or more, which 2 of 64 bits cannot reach: such texts differ in
some 15 % of their bits. Its fingerprint has 512 bits of the distinct shingles.
Five segments of 23 bits give codeword numbers as above, and a key is a pair of
numbers of two segments: two texts of similarity 0.8 share one with probability
0.92, of 0.9 with 0.99, unrelated ones with 0.0004. Rows of a key come sorted; up to
``WINDOW`` + 1 of them are compared all with all, of more each takes the nearest
of its neighbours first, which joins most of what belongs together. Then all
members of such a key that no links join yet are compared, a key of more than
``BLOCK`` in blocks. A pair that differs in at most ``NEAR_BITS`` of the 512 bits
is a link if its shingles say so, never by its bits alone. Pairs are checked in
cells, where the texts of many pairs meet once; groups of copies spare most of that
work, as pairs that verified links join already are left out.
Which texts share a key is left to chance, not exact; what
shares one is compared. ``tests/llm`` hold the recall against brute force.

Null text counts as empty and has fingerprint zero, like a text without words.
Null ids are kept; a group of null ids only has a null component. Rows that
repeat share fingerprint and component. Empty table: no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aforo.llm.common import packed, pick, stored, text_values
from aforo.llm.graph import components

SHINGLE = 3
SEED = 42
BUCKET = 256
#: Generator polynomial of the Golay code and the segments (first bit, bits).
GENERATOR = 0xC75
SEGMENTS = ((0, 23), (23, 23), (46, 18))
#: Near copies: shingle, words of the fingerprint, those of them that give keys.
COPY_SHINGLE = 5
WIDE = 8
KEY_WORDS = (1, 2, 3, 4, 5)
SIMILAR = 0.8
#: Pairs at most ``SURE_BITS`` apart look sure, but are verified like all others (only tests use it).
SURE_BITS, NEAR_BITS = 60, 104
#: Of the 64 bits at hand with a key, so many may differ in a candidate (unrelated texts: 32).
FIRST_BITS = 20
WINDOW = 16
#: Members of a large key that are compared in one task with as many others.
BLOCK = 8192
#: Least number of parts that nodes of pairs are dealt to, and pairs of two parts that are checked in one task.
PARTS = 9
CELL = 20_000


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """SimHash over the word shingles of a text, repeats counted."""
    import xxhash

    words = text.encode().lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        words = [b" ".join(words)]
    elif shingle > 1:
        words = list(map(b" ".join, zip(*[words[i:] for i in range(shingle)], strict=False)))
    digest, votes = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(words), 65_536):
        part = words[at : at + 65_536]
        hashes = np.fromiter([digest(w, SEED) for w in part], np.uint64, len(part))
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(words), bitorder="little").view("<u8")[0])


def _remainders(polynomials: np.ndarray) -> np.ndarray:
    rest = polynomials.copy()
    for bit in range(22, 10, -1):
        rest = np.where(rest >> bit & 1, rest ^ (GENERATOR << (bit - 11)), rest)
    return rest


def golay_errors() -> np.ndarray:
    """Of each of the 2,048 remainders, the one pattern of at most 3 bits that leaves it."""
    bit = 1 << np.arange(23)
    two = (bit[:, None] | bit).ravel()
    patterns = np.unique(np.concatenate([[0], (two[:, None] | bit).ravel()]))
    table = np.zeros(2048, np.int64)
    table[_remainders(patterns)] = patterns
    return table


def codeword_numbers(segments: np.ndarray, errors: np.ndarray) -> np.ndarray:
    """Numbers of the codewords near each segment and its one-bit neighbours, 24 a row."""
    near = segments[:, None] ^ np.concatenate([[0], 1 << np.arange(23)])
    return (near ^ errors[_remainders(near)]) >> 11


def golay_keys(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and key of each different key of the fingerprints (unsigned 64-bit)."""
    errors = golay_errors()
    parts = [(fingerprints >> np.uint64(at)).astype(np.int64) & ((1 << n) - 1) for at, n in SEGMENTS]
    rows, keys = [], []
    for i in range(3):
        numbers = np.sort(codeword_numbers(parts[(i + 1) % 3], errors), axis=1)
        fresh = np.ones(numbers.shape, bool)
        fresh[:, 1:] = numbers[:, 1:] != numbers[:, :-1]
        row, at = np.nonzero(fresh)
        rows.append(row)
        keys.append(i << 35 | parts[i][row] << 12 | numbers[row, at])
    return np.concatenate(rows), np.concatenate(keys)


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, h, fp)``: a hash of the text that tells rows of one id apart, and the fingerprint as a long."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, shingle) for t in text_values(batch["t"])], np.uint64)
            columns = [batch["doc_id"], batch["h"], pa.array(found.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "h", "fp"])

    rows = pick(docs, doc_id=doc_id, t=text)
    rows = rows.select(F.col("doc_id").cast("long"), F.xxhash64("t").alias("h"), "t")
    return rows.mapInArrow(read, "doc_id long, h long, fp long")


def near_links(nodes: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Links ``(a, b)`` that join all fingerprints ``fp`` of ``nodes`` at most 2 bits apart.

    Each pair that is close is linked, directly or through others as close.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch["fp"].to_numpy()
            for at in range(0, len(own), 4096):
                part = own[at : at + 4096]
                rows, keys = golay_keys(part.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(part[rows]), pa.array(keys)], ["fp", "key"])

    keys = stored(nodes.select("fp").mapInArrow(read, "fp long, key long"), "simhash-keys")
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = stored(keys.join(stored(sizes, "simhash-sizes"), "key"), "simhash-shared")
    small = shared.filter(F.col("n") <= bucket)
    other = small.select("key", F.col("fp").alias("b"))
    close = F.bit_count(F.col("fp").bitwiseXOR(F.col("b"))) <= 2
    pairs = small.join(other, "key").filter((F.col("fp") < F.col("b")) & close).select(F.col("fp").alias("a"), "b")

    members = shared.filter(F.col("n") > bucket).select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)])
    words = members.select("fp", F.explode(F.transform(flips, lambda f: f.bitwiseXOR(F.col("fp")))).alias("word"))
    stars = words.groupBy("word").agg(F.array_sort(F.collect_set("fp")).alias("all")).filter(F.size("all") > 1)
    spokes = stars.select(F.col("all")[0].alias("a"), F.explode(F.slice("all", 2, 64)).alias("b"))
    return pairs.union(spokes)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """A row per document: doc_id, h, fingerprint (hex), component_id, links.

    ``links`` counts the other fingerprints linked directly, as far as links
    are stored (members of large buckets: those of their stars).
    """
    marked = stored(fingerprints(docs, doc_id, text, shingle), "simhash-fingerprints")
    nodes = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("_least")), "simhash-nodes")
    links = stored(near_links(nodes).distinct(), "simhash-links")
    roots = components(links).withColumnRenamed("node", "fp")
    ends = links.select(F.col("a").alias("fp")).union(links.select(F.col("b").alias("fp")))
    degree = ends.groupBy("fp").agg(F.count(F.lit(1)).alias("links"))
    classes = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = classes.groupBy("root").agg(F.min("_least").alias("component_id"))
    classes = classes.join(stored(least, "simhash-least"), "root").join(degree, "fp", "left")
    classes = stored(classes.select("fp", "component_id", F.coalesce("links", F.lit(0)).alias("links")), "simhash-classes")
    named = marked.join(classes, "fp")
    return named.select("doc_id", "h", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "links")


def shingle_hashes(text: str, shingle: int = COPY_SHINGLE) -> np.ndarray:
    """Hashes of the distinct word shingles of a text; of fewer words, of their whole sequence."""
    import xxhash

    words = text.encode().lower().split()
    if len(words) <= shingle:
        shingles = {b" ".join(words)} if words else set()
    else:
        shingles = set(map(b" ".join, zip(*[words[i:] for i in range(shingle)], strict=False)))
    return np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in shingles), np.uint64, len(shingles))


def wide_fingerprint(text: str, shingle: int = COPY_SHINGLE) -> np.ndarray:
    """``WIDE`` words of 64 bits over the distinct word shingles of a text; zeros without words."""
    return wide_votes(shingle_hashes(text, shingle))


def wide_votes(hashes: np.ndarray) -> np.ndarray:
    """The wide fingerprint of distinct hashes."""
    steps = np.arange(WIDE, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    votes = np.zeros(64 * WIDE, np.int64)
    for at in range(0, len(hashes), 16_384):
        x = hashes[at : at + 16_384, None] + steps
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        bits = np.unpackbits(x.astype("<u8").view(np.uint8), axis=1, bitorder="little")
        # sums of up to 255 rows fit into a byte, which is far faster to add
        whole = len(bits) // 255 * 255
        votes += bits[:whole].reshape(-1, 255, 64 * WIDE).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        votes += bits[whole:].sum(axis=0, dtype=np.int64)
    return np.packbits(votes * 2 > len(hashes), bitorder="little").view("<u8")


def wide_fingerprints(docs: DataFrame, doc_id: str, text: str, shingle: int = COPY_SHINGLE) -> DataFrame:
    """``(doc_id, h, node, size, wide)``: hashes of the text and of its words, count of its shingles, fingerprint."""
    import xxhash

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, sizes, nodes = np.zeros((len(batch), WIDE), np.uint64), [], np.zeros(len(batch), np.uint64)
            for i, t in enumerate(text_values(batch["t"])):
                hashes = shingle_hashes(t, shingle)
                found[i] = wide_votes(hashes)
                sizes.append(len(hashes))
                nodes[i] = xxhash.xxh64_intdigest(b" ".join(t.encode().lower().split()), SEED)
            found, size = found.view(np.int64), pa.array(sizes, pa.int64())
            wide = pa.FixedSizeListArray.from_arrays(pa.array(found.ravel()), WIDE).cast(pa.list_(pa.int64()))
            columns = [batch["doc_id"], batch["h"], pa.array(nodes.view(np.int64)), size, wide]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "h", "node", "size", "wide"])

    rows = pick(docs, doc_id=doc_id, t=text)
    rows = rows.select(F.col("doc_id").cast("long"), F.xxhash64("t").alias("h"), "t")
    return rows.mapInArrow(read, "doc_id long, h long, node long, size long, wide array<long>")


def pair_keys(wide: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and key of all pairs of codeword numbers of two segments each."""
    errors = golay_errors()
    numbers, fresh = [], []
    for word in KEY_WORDS:
        near = np.sort(codeword_numbers((wide[:, word] & np.uint64((1 << 23) - 1)).astype(np.int64), errors), axis=1)
        new = np.ones(near.shape, bool)
        new[:, 1:] = near[:, 1:] != near[:, :-1]
        # the (at most 6) different numbers first
        order = np.argsort(~new, axis=1, kind="stable")[:, :6]
        numbers.append(np.take_along_axis(near, order, 1))
        fresh.append(np.take_along_axis(new, order, 1))
    rows, keys, kind = [], [], 0
    for i in range(len(KEY_WORDS)):
        for j in range(i + 1, len(KEY_WORDS)):
            row, a, b = np.nonzero(fresh[i][:, :, None] & fresh[j][:, None, :])
            rows.append(row)
            keys.append(kind << 24 | numbers[i][row, a] << 12 | numbers[j][row, b])
            kind += 1
    return np.concatenate(rows), np.concatenate(keys).astype(np.int32)


def _neighbours(key: np.ndarray, fp: np.ndarray, fresh_from: int) -> tuple[np.ndarray, np.ndarray]:
    """Candidates among rows sorted by key; pairs of two rows before ``fresh_from`` were given already.

    Rows up to ``WINDOW`` apart are compared. A row with more members of its key
    after it than that gives the nearest of them only.
    """
    n = len(key)
    large = np.zeros(n, bool)
    large[: max(n - WINDOW - 1, 0)] = key[WINDOW + 1 :] == key[: max(n - WINDOW - 1, 0)]
    best, at = np.full(n, 65), np.zeros(n, np.int64)
    left, right = [], []
    for step in range(1, min(WINDOW, n - 1) + 1):
        i = np.flatnonzero(key[step:] == key[:-step])
        if not len(i):
            break
        bits = np.bitwise_count(fp[i] ^ fp[i + step])
        close = (bits <= FIRST_BITS) & (i + step >= fresh_from)
        small = close & ~large[i]
        left.append(i[small])
        right.append(i[small] + step)
        i, bits = i[close & large[i]], bits[close & large[i]]
        nearer = bits < best[i]
        best[i[nearer]], at[i[nearer]] = bits[nearer], i[nearer] + step
    i = np.flatnonzero(best <= 64)
    return np.concatenate([*left, i]), np.concatenate([*right, at[i]])


def shared_keys(nodes: DataFrame) -> DataFrame:
    """``(key, node, fp, n)`` of the keys that ``n`` > 1 nodes share; ``fp`` is the first word of the fingerprint."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = batch["node"].to_numpy()
            wide = batch["wide"].flatten().to_numpy().view(np.uint64).reshape(-1, WIDE)
            for at in range(0, len(wide), 1024):
                part = wide[at : at + 1024]
                rows, keys = pair_keys(part)
                columns = [pa.array(keys), pa.array(node[at : at + 1024][rows]), pa.array(part[rows, 0].view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, ["key", "node", "fp"])

    keys = nodes.select("node", "wide").mapInArrow(spread, "key int, node long, fp long")
    return keys.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("key"))).filter("n > 1")


def _ordered(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def key_matches(shared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What one pass over the keys finds, stored.

    Distinct pairs ``(a, b)`` of nodes that share a key and look alike in 64 bits,
    of large keys nearest ones only; and ``(key, node, fp)`` of the large keys. The
    rows come from the exchange that counted them, sorted in place: they are
    neither written nor shuffled again.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, node, fp = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            large = batch.filter(pa.array(batch["n"].to_numpy() > WINDOW + 1))
            yield pa.RecordBatch.from_arrays([large["key"], large["node"], large["fp"]], ["key", "a", "b"])
            old = len(key)
            key, node = np.concatenate([key, batch["key"].to_numpy()]), np.concatenate([node, batch["node"].to_numpy()])
            fp = np.concatenate([fp, batch["fp"].to_numpy()])
            i, j = _neighbours(key, fp.view(np.uint64), old)
            a, b = _ordered(node[i], node[j]).columns
            yield pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.int32()), a, b], ["key", "a", "b"])
            key, node, fp = key[-WINDOW:], node[-WINDOW:], fp[-WINDOW:]

    # each kind of key sorts by other bits first, so that neighbours differ from key to key
    turn = F.shiftright("key", 24) * 6
    order = F.call_function("shiftleft", F.col("fp"), turn).bitwiseOR(F.call_function("shiftrightunsigned", F.col("fp"), 64 - turn))
    found = stored(shared.sortWithinPartitions("key", order).mapInArrow(compare, "key int, a long, b long"), "copies-found")
    large = found.filter(F.col("key").isNotNull()).select("key", F.col("a").alias("node"), F.col("b").alias("fp"))
    return found.filter(F.col("key").isNull()).select("a", "b").distinct(), large


def _unjoined(fp: np.ndarray, root: np.ndarray, own: np.ndarray, across: bool, nearest: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of different roots that look alike in 64 bits among rows sorted by root, ``across``: of two blocks."""
    ends = np.searchsorted(root, root, side="right")
    kept = [np.zeros((0, 3), np.int64)]
    at = 0
    while at < len(fp) and ends[at] < len(fp):
        to, first = at + 128, ends[at]
        bits = np.bitwise_count(fp[at:to, None] ^ fp[first:])
        fits = (bits <= FIRST_BITS) & (root[at:to, None] < root[first:])
        if across:
            fits &= own[at:to, None] != own[first:]
        i, j = np.nonzero(fits)
        bits, i, j = bits[i, j], i + at, j + first
        if nearest:
            # of each pair of roots the nearest so far
            rows = np.concatenate([*kept, np.stack([bits.astype(np.int64), i, j], axis=1)])
            rows = rows[np.lexsort((rows[:, 0], root[rows[:, 2]], root[rows[:, 1]]))]
            a, b = root[rows[:, 1]], root[rows[:, 2]]
            fresh = np.ones(len(rows), bool)
            fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            # roots are sorted, so those before the next row's are done
            rows = rows[fresh]
            going = root[rows[:, 1]] == root[min(to, len(fp) - 1)]
            kept = [rows[going]]
            i, j = rows[~going, 1], rows[~going, 2]
        yield i, j
        at = to
    yield kept[0][:, 1], kept[0][:, 2]


def unjoined_pairs(large: DataFrame, labels: DataFrame, nearest: bool) -> DataFrame:
    """Distinct ``(a, b, low, high)``: pairs that share a key of ``large``, look alike in 64 bits and have the different roots ``low`` and ``high``.

    All of them, or of each key and two roots a ``nearest`` one. A key with
    more members than ``BLOCK`` is cut into blocks, and every two blocks meet.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("key", "p", "q", "own", "node", "fp", "root")

        def pairs(cell: np.ndarray) -> Iterator[pa.RecordBatch]:
            _, p, q, own, node, fp, root = cell
            for i, j in _unjoined(fp.view(np.uint64), root, own, p[0] != q[0], nearest):
                a, b = _ordered(node[i], node[j]).columns
                yield pa.RecordBatch.from_arrays([a, b, pa.array(root[i]), pa.array(root[j])], ["a", "b", "low", "high"])

        rest = np.zeros((len(names), 0), np.int64)
        for batch in batches:
            rest = np.concatenate([rest, np.stack([batch[c].to_numpy().astype(np.int64) for c in names])], axis=1)
            cuts = np.flatnonzero((rest[:3, 1:] != rest[:3, :-1]).any(axis=0)) + 1
            for at, to in zip([0, *cuts[:-1]], cuts, strict=False):
                yield from pairs(np.ascontiguousarray(rest[:, at:to]))
            rest = rest[:, cuts[-1] :] if len(cuts) else rest
        if rest.shape[1]:
            yield from pairs(np.ascontiguousarray(rest))

    rows = large.select("key", "node", "fp").join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rows = stored(rows, "copies-rooted")
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("_low"), F.max("root").alias("_high"))
    sizes = sizes.filter("_low < _high").select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts"))
    rows = rows.join(stored(sizes, "copies-sizes"), "key").withColumn("own", F.pmod(F.xxhash64("node"), "parts").cast("int"))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.withColumns({"p": F.least("own", "_other"), "q": F.greatest("own", "_other")})
    rows = rows.select("key", "p", "q", "own", "node", "fp", "root").repartition("key", "p", "q")
    return rows.sortWithinPartitions("key", "p", "q", "root").mapInArrow(compare, "a long, b long, low long, high long").distinct()


def shingle_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """``(node, wide, s)`` with ``s``, the sorted hashes of the shingles of ``texts(node, wide, t)``."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.sort(shingle_hashes(t, shingle).view(np.int64)) for t in text_values(batch["t"])]
            yield pa.RecordBatch.from_arrays([batch["node"], batch["wide"], pa.array(sets, pa.list_(pa.int64()))], ["node", "wide", "s"])

    return texts.mapInArrow(read, "node long, wide array<long>, s array<long>")


def in_cells(pairs: DataFrame, ends: DataFrame, check: Callable[[pa.Table, np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """Those of the stored ``pairs(a, b)`` that ``check`` keeps, given rows of ``ends(node, ...)`` and where in them the ends are.

    Nodes are dealt to parts and pairs to cells, one for each two parts. A node is sent
    once to each cell that has pairs of it: never oftener than a join would repeat it, and in a
    dense family far less. Parts grow with the pairs, so that cells do not.
    """
    parts = max(PARTS, math.ceil(math.sqrt(2 * pairs.count() / CELL)))
    i, j = (F.pmod(F.xxhash64(end), F.lit(parts)) for end in "ab")
    dealt = pairs.select("a", "b", (F.least(i, j) * parts + F.greatest(i, j)).alias("cell"))
    asked = dealt.select(F.col("a").alias("node"), "cell").union(dealt.select(F.col("b").alias("node"), "cell"))
    asked = asked.groupBy("node").agg(F.collect_set("cell").alias("_cells"))
    sent = ends.join(asked, "node").withColumn("cell", F.explode("_cells")).drop("_cells")

    def read(own: pa.Table, rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        node, a, b = rows["node"].to_numpy(), own["a"].to_numpy(), own["b"].to_numpy()
        order = np.argsort(node)
        left, right = (order[np.searchsorted(node, end, sorter=order)] for end in (a, b))
        kept = check(rows, left, right)
        return pa.table({"a": a[kept], "b": b[kept]})

    return dealt.groupBy("cell").cogroup(sent.groupBy("cell")).applyInArrow(read, "a long, b long")


def _bits_apart(wide: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    apart = np.zeros(len(left), np.int64)
    for at in range(0, len(left), 16_384):
        some = slice(at, at + 16_384)
        apart[some] = np.bitwise_count(wide[left[some]] ^ wide[right[some]]).sum(axis=1)
    return apart


def _wide_rows(rows: pa.Table) -> np.ndarray:
    return rows["wide"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, WIDE)


def near_pairs(pairs: DataFrame, nodes: DataFrame, similar: float) -> DataFrame:
    """Those of ``pairs(a, b)`` that sizes and bits of ``nodes(node, size, wide)`` leave open."""

    def check(rows: pa.Table, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        size = rows["size"].to_numpy()
        fits = np.minimum(size[left], size[right]) >= similar * np.maximum(size[left], size[right])
        return fits & (_bits_apart(_wide_rows(rows), left, right) <= NEAR_BITS)

    return in_cells(pairs, nodes.select("node", "size", "wide"), check)


def similar_pairs(pairs: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """Links that join all of ``pairs(a, b)`` near in bits whose shingle sets are similar; ``sets(node, wide, s)`` has a row for each end.

    A cell takes its nearest pairs first. Each link is verified, and a pair that verified
    links of its cell join already is left out.
    """

    def check(rows: pa.Table, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        lists = rows["s"].combine_chunks()
        flat, ends = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
        size, root = np.diff(ends), list(range(len(lists)))

        def find(n: int) -> int:
            while root[n] != n:
                root[n] = n = root[root[n]]
            return n

        apart = _bits_apart(_wide_rows(rows), left, right)
        fits = np.minimum(size[left], size[right]) >= similar * np.maximum(size[left], size[right])
        at = np.flatnonzero(fits & (apart <= NEAR_BITS))
        kept = []
        for k in at[np.argsort(apart[at], kind="stable")].tolist():
            i, j = int(left[k]), int(right[k])
            if find(i) == find(j):
                continue
            both = np.concatenate([flat[ends[i] : ends[i + 1]], flat[ends[j] : ends[j + 1]]])
            both.sort(kind="stable")  # two sorted runs are merged
            common = int(np.count_nonzero(both[1:] == both[:-1]))
            if common >= similar * (len(both) - common):
                root[find(j)] = find(i)
                kept.append(k)
        return np.array(kept, np.int64)

    return in_cells(pairs, sets, check)


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = COPY_SHINGLE, similar: float = SIMILAR) -> DataFrame:
    """A row per document: doc_id, h, component_id, the least id of its near copies and theirs."""
    return copy_groups(docs, doc_id, text, shingle, similar).drop("root")


def copy_groups(docs: DataFrame, doc_id: str, text: str, shingle: int = COPY_SHINGLE, similar: float = SIMILAR) -> DataFrame:
    """:func:`near_copies` with ``root``, which tells groups apart that have no id or share their least one.

    Texts of the same words are one node, however many.
    """
    marked = stored(wide_fingerprints(docs, doc_id, text, shingle), "copies-fingerprints")
    node = marked.groupBy("node").agg(F.min("doc_id").alias("_least"), F.min(F.struct("h", "size", "wide")).alias("_m"))
    nodes = stored(node.select("node", "_least", "_m.h", "_m.size", "_m.wide"), "copies-nodes")
    candidates, large = key_matches(shared_keys(nodes))
    first = stored(near_pairs(stored(candidates, "copies-candidates"), nodes, similar), "copies-near")
    ends = first.select(F.col("a").alias("node")).union(first.select(F.col("b").alias("node"))).union(large.select("node"))
    asked = stored(nodes.select("node", "h", "wide").join(ends.distinct(), "node"), "copies-asked")
    texts = pick(docs, t=text).withColumn("h", F.xxhash64("t")).join(asked, "h").select("node", "wide", "t").dropDuplicates(["node"])
    sets = stored(shingle_sets(texts, shingle), "copies-sets")

    links = stored(similar_pairs(first, sets, similar), "copies-links")
    # of large keys a nearest pair of each two groups, then whatever is still apart
    for nearest in (True, False):
        more = stored(unjoined_pairs(large, components(links), nearest).select("a", "b").distinct(), "copies-open")
        links = stored(links.union(similar_pairs(more, sets, similar)), "copies-links")

    roots = components(links)
    classes = nodes.select("node", "_least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = classes.groupBy("root").agg(F.min("_least").alias("component_id"))
    classes = stored(classes.join(stored(least, "copies-least"), "root").select("node", "root", "component_id"), "copies-classes")
    return marked.select("doc_id", "h", "node").join(classes, "node").select("doc_id", "h", "root", "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = COPY_SHINGLE) -> DataFrame:
    """The document with the least id of each group of :func:`near_copies`, all columns.

    A null id comes after all others. Of rows with that id, the one with the
    least text hash stays, once.
    """
    found = copy_groups(docs, doc_id, text, shingle)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h"))
    chosen = found.groupBy("root").agg(least.alias("_m")).select("root", F.col("_m.doc_id").alias("_id"), F.col("_m.h").alias("_h"))
    chosen = stored(chosen, "simhash-chosen")
    rows = packed(docs, id=F.col(f"`{doc_id}`").cast("long"), h=F.xxhash64(F.col(f"`{text}`")))
    kept = rows.join(chosen, F.col("id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")))
    return kept.dropDuplicates(["root"]).select("row.*")
