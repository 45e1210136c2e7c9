"""Language-model scores from a weighted backoff automaton over n-grams.

States are the contexts of up to ``order - 1`` tokens. A state has an arc for
each n-gram seen in training, and a failure arc to the context shorter by its
oldest token, down to the single state of no context, whose arcs are the add-one
unigrams. A document is read once from left to right: at each token the state's
arc is taken, or failure arcs until there is one, and the next state follows.

Arcs and failure arcs are smoothed by interpolation: with ``m`` the share of the
lower order, ``P(w|h) = (1 - m) c(hw) / c(h) + m P(w|h')``. ``m`` depends on the
class of ``c(h)``, its binary logarithm: by Good and Turing it is the share of
training tokens after contexts of the class whose n-gram occurs only once.

The model is never in one place. Documents are cut into blocks of about
``BLOCK_TOKENS`` tokens, stored as local ids. Order by order each block asks for
the training counts of its distinct n-grams: sorted 64-bit hashes, dealt to
shards by their leading bits, each with the count of its own block. A shard adds
the counts up and answers every block in the order of its question. N-grams of
one frequent context spread over all shards, and a frequent n-gram is one number
of a block. A block then builds the part of the automaton that it needs; its
memory is bounded by the block (or the longest text) and that of a shard by
``SHARD_BYTES``. The driver sees sums per class only.

Tokens are ASCII-lower-cased words and one end. Null text: empty, the end alone.
Null id: neither learnt from nor held out. Repeated rows are learnt and scored
each. Nothing to learn from: N and V are 0 and every token has probability 1.
Empty table: no rows. Equal hashes of different n-grams would share a count; at
64 bits that is rare even for 10**9 of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aforo.llm.common import pick, stored

ORDER = 2
BLOCK_TOKENS = 2_000_000
SHARD_BYTES = 32 << 20
CLASSES = 64
BLOCK_SCHEMA = "block long, tokens_n long, docs binary, tokens binary, vocabulary binary"
ASK_SCHEMA = "shard int, block long, hashes binary, counts binary, classes binary"
ANSWER_SCHEMA = "block long, level int, shard int, counts binary, stats array<long>"
SCORE_SCHEMA = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
)
#: No word holds white space, so these names of the end and of what precedes a text are free.
END, START = b"\n", b"\n\n"


def _squeeze(values: np.ndarray) -> bytes:
    """Unsigned integers by byte planes, compressed."""
    import zstandard

    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def _expand(data: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes, by the order given."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


class Levels:
    """The distinct n-grams of a block, order by order.

    ``hashes[n]`` are sorted, ``at[n]`` says which of them ends at each token
    and ``before[n]`` which of ``hashes[n - 1]`` is its context. For order 1 the
    n-grams are the vocabulary, in which ``START`` stands but never occurs.
    """

    def __init__(self, docs: np.ndarray, tokens: np.ndarray, vocabulary: np.ndarray, order: int):
        self.lengths, trained = docs["n"].astype(np.int64), docs["learn"].astype(bool)
        self.trained = np.repeat(trained, self.lengths)
        self.first = np.cumsum(self.lengths) - self.lengths
        self.hashes, self.at, self.before = {1: vocabulary}, {1: tokens.astype(np.int64)}, {}
        self.own = {1: np.bincount(self.at[1][self.trained], minlength=len(vocabulary))}
        start = pad = int(np.searchsorted(vocabulary, _start_hash()))
        self.own[1][pad] += int(trained.sum())
        for n in range(2, order + 1):
            context = np.empty_like(self.at[1])
            context[1:] = self.at[n - 1][:-1]
            context[self.first] = pad
            size = np.int64(len(vocabulary))
            codes, at = np.unique(context * size + self.at[1], return_inverse=True)
            hashes = _mix(self.hashes[n - 1][codes // size], vocabulary[codes % size])
            padding = _mix(self.hashes[n - 1][pad : pad + 1], vocabulary[start : start + 1])
            hashes = np.concatenate([hashes, padding])
            order_ = np.argsort(hashes, kind="stable")
            rank = np.empty(len(order_), np.int64)
            rank[order_] = np.arange(len(order_))
            self.hashes[n], self.at[n], self.before[n] = hashes[order_], rank[at], context
            self.own[n] = np.bincount(self.at[n][self.trained], minlength=len(hashes))
            pad = int(rank[-1])
            self.own[n][pad] += int(trained.sum())


DOC = np.dtype([("id", "<i8"), ("null", "u1"), ("learn", "u1"), ("held", "u1"), ("n", "<i8")])


def _levels(row: dict, order: int) -> tuple[np.ndarray, Levels]:
    docs = np.frombuffer(row["docs"], DOC)
    return docs, Levels(docs, _expand(row["tokens"]), _expand(row["vocabulary"]), order)


def cut_blocks(docs: DataFrame, learn: Column, held_out: Column, doc_id: str, text: str, size: int = BLOCK_TOKENS) -> DataFrame:
    """Documents as stored blocks of local token ids, in the order of the scan; no shuffle."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        part, made = TaskContext.get().partitionId(), 0
        number: dict[bytes, int] = {END: 0, START: 1}
        rows: list[tuple] = []
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            nonlocal made, number, rows, held
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, number), np.uint64, len(number))
            order = np.argsort(hashes)
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order), dtype=np.uint32)
            tokens = rank[np.concatenate(held)]
            columns = [[part << 32 | made], [len(tokens)], [np.array(rows, DOC).tobytes()], [_squeeze(tokens)], [_squeeze(hashes[order])]]
            made, number, rows, held = made + 1, {END: 0, START: 1}, [], []
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
            names = [f.split()[0] for f in BLOCK_SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        total = 0
        for batch in batches:
            for key, learns, is_held, t in zip(*(batch[c].to_pylist() for c in ("k", "learn", "held", "t")), strict=True):
                words = (t or "").encode().lower().split()
                for w in words:
                    if w not in number:
                        number[w] = len(number)
                words.append(END)
                held.append(np.fromiter(map(number.__getitem__, words), np.uint32, len(words)))
                rows.append((key or 0, key is None, bool(learns), bool(is_held), len(words)))
                total += len(words)
                if total >= size:
                    yield flush()
                    total = 0
        if rows:
            yield flush()

    picked = docs.withColumns({"_learn": learn, "_held": held_out})
    rows = pick(picked, k=doc_id, learn="_learn", held="_held", t=text).withColumn("k", F.col("k").cast("long"))
    return stored(rows.mapInArrow(read, BLOCK_SCHEMA), "lm-blocks")


def _counts(answers: pa.Table) -> dict[int, np.ndarray]:
    """Counts of each level, in the order in which the block asked."""
    found: dict[int, list] = {}
    for row in sorted(answers.to_pylist(), key=lambda r: (r["level"], r["shard"])):
        found.setdefault(row["level"], []).append(_expand(row["counts"]).astype(np.int64))
    return {level: np.concatenate(parts) for level, parts in found.items()}


def _class_of(counts: np.ndarray) -> np.ndarray:
    """Binary logarithm of each count; class 0 also holds what never occurs."""
    return np.minimum(np.log2(np.maximum(counts, 1)).astype(np.int64), CLASSES - 1)


def _table(columns: list, schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()),
             "double": pa.float64(), "boolean": pa.bool_()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.Table.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def count_level(blocks: DataFrame, answers: DataFrame | None, level: int, shards: int) -> DataFrame:
    """Training counts of all n-grams of an order, as stored answers to the blocks."""
    bits = (shards - 1).bit_length()

    def ask(row: dict, counts: dict[int, np.ndarray]) -> pa.Table:
        _, levels = _levels(row, level)
        hashes, own = levels.hashes[level], levels.own[level]
        classes = np.zeros(len(hashes), np.uint64)
        if level > 1:
            classes[levels.at[level]] = _class_of(counts[level - 1])[levels.before[level]].astype(np.uint64)
        shard = (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)
        cut = np.flatnonzero(np.diff(shard, prepend=-1))
        ends = [*cut[1:], len(hashes)]
        parts = [(int(shard[a]), row["block"], _squeeze(np.diff(hashes[a:b], prepend=np.uint64(0))), _squeeze(own[a:b]), _squeeze(classes[a:b]))
                 for a, b in zip(cut, ends, strict=True)]
        return _table(list(zip(*parts, strict=True)), ASK_SCHEMA)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from ask(row, {}).to_batches()

    def later(left: pa.Table, right: pa.Table) -> pa.Table:
        return pa.concat_tables([ask(row, _counts(right)) for row in left.to_pylist()]) if len(left) else _table([[]] * 5, ASK_SCHEMA)

    def add(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        hashes = [np.cumsum(_expand(r["hashes"]), dtype=np.uint64) for r in rows]
        flat = np.concatenate(hashes)
        values, place, at = np.unique(flat, return_index=True, return_inverse=True)
        own = np.concatenate([_expand(r["counts"]) for r in rows])
        total = np.bincount(at, own.astype(np.float64), len(values)).astype(np.int64)
        kind = np.concatenate([_expand(r["classes"]) for r in rows])[place].astype(np.int64)
        # what stands before a text is a context, no n-gram
        total_words = np.where(values == _padding_hash(level), 0, total)
        stats = np.concatenate([
            np.bincount(kind[total_words == 1], minlength=CLASSES),
            np.bincount(kind, total_words, CLASSES).astype(np.int64),
            np.bincount(kind[total_words > 0], minlength=CLASSES),
        ])
        ends = np.cumsum([len(h) for h in hashes])
        answers = [_squeeze(total[at[e - len(h) : e]]) for h, e in zip(hashes, ends, strict=True)]
        shard = rows[0]["shard"]
        return _table(
            [[r["block"] for r in rows], [level] * len(rows), [shard] * len(rows), answers, [stats.tolist()] + [None] * (len(rows) - 1)],
            ANSWER_SCHEMA,
        )

    if answers is None:
        asked = blocks.mapInArrow(first, ASK_SCHEMA)
    else:
        asked = blocks.groupBy("block").cogroup(answers.filter(F.col("level") == level - 1).drop("stats").groupBy("block")).applyInArrow(later, ASK_SCHEMA)
    return stored(asked.groupBy("shard").applyInArrow(add, ANSWER_SCHEMA), f"lm-counts-{level}")


def _start_hash() -> np.uint64:
    import xxhash

    return np.uint64(xxhash.xxh64_intdigest(START))


def _padding_hash(level: int) -> np.uint64:
    start = np.array([_start_hash()])
    out = start
    for _ in range(level - 1):
        out = _mix(out, start)
    return out[0]


def class_sums(answers: DataFrame) -> np.ndarray:
    """Singletons, tokens and types by class of context, over all shards."""
    rows = answers.filter("stats IS NOT NULL").select(F.posexplode("stats").alias("i", "v"))
    out = np.zeros(3 * CLASSES, np.int64)
    for r in rows.groupBy("i").agg(F.sum("v").alias("v")).collect():
        out[r["i"]] = r["v"]
    return out.reshape(3, CLASSES)


def score_blocks(blocks: DataFrame, answers: DataFrame, order: int, n_train: int, types: int, lower: dict[int, np.ndarray]) -> DataFrame:
    """Walk the automaton of each block over its documents."""

    def walk(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left):
            return _table([[]] * 7, SCORE_SCHEMA)
        counts = _counts(right)
        docs, levels = _levels(left.to_pylist()[0], order)
        tokens = levels.at[1]
        # arcs of the state without context: add-one unigrams with one place for all unknown words
        arc = np.log10((np.where(levels.hashes[1] == _start_hash(), 0, counts[1]) + 1) / (n_train + types + 1))
        word = arc[tokens]
        probability, per_token = 10.0**word, {1: word}
        seen, fail = {1: np.ones(len(tokens), bool)}, {}
        for n in range(2, order + 1):
            context, here = counts[n - 1][levels.before[n]], counts[n][levels.at[n]]
            share = np.where(context > 0, lower[n][_class_of(context)], 1.0)
            probability = (1 - share) * here / np.maximum(context, 1) + share * probability
            seen[n], fail[n] = here > 0, np.log10(share)
            per_token[n] = np.log10(probability)
        # one pass, all documents of the block abreast: take the arc, or fail to the shorter context
        total, open_ = np.zeros(len(tokens)), np.ones(len(tokens), bool)
        for n in range(order, 0, -1):
            take = open_ & seen[n]
            total[take] += per_token[n][take]
            open_ &= ~take
            if n > 1:
                total[open_] += fail[n][open_]
        add = lambda x: np.add.reduceat(x, levels.first)  # noqa: E731  no document is without an end
        known = (counts[1] > 0)[tokens]
        ids = [None if d["null"] else int(d["id"]) for d in docs]
        columns = [ids, docs["held"].astype(bool), docs["n"], add(known.astype(np.int64)), np.full(len(docs), n_train), add(word), add(total)]
        return _table(columns, SCORE_SCHEMA)

    plain = answers.drop("stats")
    return blocks.drop("tokens_n").groupBy("block").cogroup(plain.groupBy("block")).applyInArrow(walk, SCORE_SCHEMA)


def scores(docs: DataFrame, learn: Column, held_out: Column, doc_id: str = "doc_id", text: str = "text", order: int = ORDER) -> DataFrame:
    """A row per document: tokens, known tokens, training tokens, base and model score (log10).

    ``learn`` and ``held_out`` are columns over ``docs``; null means no.
    """
    false = F.lit(False)
    blocks = cut_blocks(docs, F.coalesce(learn, false), F.coalesce(held_out, false), doc_id, text)
    tokens = blocks.agg(F.sum("tokens_n")).first()[0] or 0
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = 1 << (max(least, tokens * 8 // SHARD_BYTES) - 1).bit_length()
    answers, lower = None, {}
    n_train = types = 0
    for level in range(1, order + 1):
        found = count_level(blocks, answers, level, shards)
        singles, total, kinds = class_sums(found)
        if level == 1:
            n_train, types = int(total.sum()), int(kinds.sum())
        else:
            lower[level] = np.clip((singles + 0.5) / (total + 1.0), 1e-4, 1 - 1e-4)
        answers = found if answers is None else answers.unionByName(found)
    return score_blocks(blocks, answers, order, n_train, types, lower)
