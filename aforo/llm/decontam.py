"""Benchmark decontamination by greedy string tiling.

A tile is a longest run of words that a document and a benchmark item share and
that overlaps no earlier tile in either. Tiles are marked from the longest to
``least`` words, so a passage whose sentences stand in another order is covered
as well as one copied whole. An item counts as leaked into a document if tiles
cover at least ``share`` of its words.

The benchmark is the stated query set. It is cut into blocks of at most
``BLOCK_WORDS`` words; only one block is on the driver and broadcast at a time,
whatever the size of the benchmark: with several, each one's result is stored
before the next is read. In a task a document is reduced to its words that the block
knows; runs of ``least`` of them are seeds, looked up by a rolling hash and
compared word by word. Items whose seeds could cover enough are tiled in full.
Documents are read whole and never shuffled.

Words are cut at white space, lower-cased, and stripped of what is not a
letter or digit at their ends; bare punctuation is no word. Items of fewer than
``least`` words leak only into documents of which they are a whole line or the
whole text, as such runs stand in clean texts. Null or empty texts and items match nothing;
null ids are kept; repeated rows give repeated results; an empty benchmark or
table gives no rows.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aforo.llm.common import kept_in_process, packed, pick, stored

LEAST = 5
SHARE = 0.5
BLOCK_WORDS = 1_000_000
MEMO = 400_000
UNKNOWN, NO_WORD = -1, -2
RESULT_SCHEMA = "doc_id long, h long, item_id long, item_words long, covered_words long, tiles long, coverage double"
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def normal_words(text: str) -> list[str]:
    """Lower-cased words without punctuation at their ends."""
    out = []
    for word in (w.lower() for w in text.split()):
        if not word.isalnum():
            a, b = 0, len(word)
            while a < b and not word[a].isalnum():
                a += 1
            while b > a and not word[b - 1].isalnum():
                b -= 1
            word = word[a:b]
        if word:
            out.append(word)
    return out


def rolling(ids: np.ndarray, length: int) -> np.ndarray:
    """Karp-Rabin hashes of all runs of ``length`` ids, modulo 2**64."""
    n = len(ids) - length + 1
    out = np.zeros(max(n, 0), np.uint64)
    for i in range(length if n > 0 else 0):
        out = out * MULTIPLIER + ids[i : i + n].astype(np.uint64) + np.uint64(1)
    return out ^ (out >> np.uint64(29))


def common_runs(doc: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """``(place in doc, place in item, length)`` of all longest common runs of ``least`` words or more.

    Karp-Rabin seeds of each place of the item are joined to those of the place
    before, diagonal by diagonal; only the seeds of two places are held.
    """
    own, other = rolling(doc, least), rolling(item, least)
    runs: list[tuple[int, int, int]] = []
    if not len(own) or not len(other):
        return runs
    order = np.argsort(own, kind="stable")
    lo, hi = np.searchsorted(own, other, "left", order), np.searchsorted(own, other, "right", order)
    windows = np.lib.stride_tricks.sliding_window_view(doc, least)
    before, seeds = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for i in range(len(other) + 1):
        places = order[lo[i] : hi[i]] if i < len(other) else order[:0]
        if len(places):
            places = places[(windows[places] == item[i : i + least]).all(axis=1)]
        ended = ~np.isin(before + 1, places, assume_unique=True)
        for d, n in zip(before[ended].tolist(), seeds[ended].tolist(), strict=True):
            runs.append((d - n + 1, i - n, n + least - 1))
        now = np.ones(len(places), np.int64)
        at = np.searchsorted(before, places - 1)
        on = np.flatnonzero(at < len(before))
        on = on[before[at[on]] == places[on] - 1]
        now[on] += seeds[at[on]]
        before, seeds = places, now
    return runs


def tile(doc: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: ``(place in doc, place in item, length)`` of the tiles.

    Always the longest common run of unmarked words is marked next, ties by
    place in the document, then in the item.
    """
    free_d, free_i = np.ones(len(doc), bool), np.ones(len(item), bool)
    tiles = []
    heap = [(-size, d, i) for d, i, size in common_runs(doc, item, least)]
    heapq.heapify(heap)
    left = len(item)
    while heap and left >= least:
        size, d, i = heapq.heappop(heap)
        free = free_d[d : d - size] & free_i[i : i - size]
        if free.all():
            free_d[d : d - size] = free_i[i : i - size] = False
            tiles.append((d, i, -size))
            left += size
            continue
        # an earlier tile took a part: what is still unmarked comes back by its own length
        edges = np.flatnonzero(np.diff(np.concatenate(([False], free, [False])).astype(np.int8)))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if b - a >= least:
                heapq.heappush(heap, (a - b, d + a, i + a))
    return tiles


class Memo(dict):
    """Ids of words as they stand in texts; each form is normalised once."""

    def __init__(self, vocabulary: dict[str, int]):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, form: str) -> int:
        words = normal_words(form)
        self[form] = out = self.vocabulary.get(words[0], UNKNOWN) if words else NO_WORD
        return out


class Block:
    """Some items of the benchmark, as ids of their own vocabulary, and their seeds."""

    def __init__(self, items: list[tuple[int, str]], least: int, share: float):
        self.least, self.share = least, share
        self.vocabulary: dict[str, int] = {}
        self.memo = Memo(self.vocabulary)
        self.items = []
        self.short: dict[tuple[int, ...], list[int]] = {}
        for key, text in items:
            words = normal_words(text or "")
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
            if len(ids) >= least:
                self.items.append((key, np.array(ids, np.int64)))
            elif ids:
                self.short.setdefault(tuple(ids), []).append(key)
        hashes = [rolling(ids, least) for _, ids in self.items] or [np.zeros(0, np.uint64)]
        flat = np.concatenate(hashes)
        order = np.argsort(flat, kind="stable")
        self.seeds = flat[order]
        self.owner = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes])[order]

    def short_matches(self, text: str, ids: np.ndarray) -> Iterator[tuple[int, int, int, int, float]]:
        """Items too short for a tile that are a whole line of the text, or all of it."""
        lines = {tuple(ids.tolist())} if len(ids) < self.least else set()
        for line in text.splitlines():
            own = [n for n in map(self.memo.__getitem__, line.split()) if n != NO_WORD]
            if len(own) < self.least:
                lines.add(tuple(own))
        for line in sorted(lines & self.short.keys()):
            for key in self.short[line]:
                yield key, len(line), len(line), 1, 1.0

    def matches(self, text: str) -> Iterator[tuple[int, int, int, int, float]]:
        if len(self.memo) > MEMO:
            self.memo.clear()
        words = text.split()
        ids = np.fromiter(map(self.memo.__getitem__, words), np.int64, len(words))
        ids = ids[ids != NO_WORD]
        if self.short:
            yield from self.short_matches(text, ids)
        own = rolling(ids, self.least)
        if not len(own):
            return
        # a run with an unknown word cannot be a seed
        known = np.convolve(ids >= 0, np.ones(self.least, int), "valid") == self.least
        values = np.unique(own[known])
        lo, hi = np.searchsorted(self.seeds, values, "left"), np.searchsorted(self.seeds, values, "right")
        counts: dict[int, int] = {}
        for a, b in zip(lo[hi > lo].tolist(), hi[hi > lo].tolist(), strict=True):
            for n in self.owner[a:b].tolist():
                counts[n] = counts.get(n, 0) + 1
        for n, seeds in sorted(counts.items()):
            key, item = self.items[n]
            if seeds * self.least < self.share * len(item):
                continue  # even apart, these seeds cover too little
            tiles = tile(ids, item, self.least)
            covered = sum(t[2] for t in tiles)
            if covered and covered >= self.share * len(item):
                yield key, len(item), covered, len(tiles), covered / len(item)


def blocks(benchmark: DataFrame, words: int) -> list[DataFrame]:
    """The benchmark in parts of about ``words`` words, by hash of the item."""
    total = benchmark.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // (words * 4)) or 1
    return [benchmark.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i) for i in range(n)]


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    least: int = LEAST,
    share: float = SHARE,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """A row per document and item that leaked into it; ``h`` is a hash of the document's text."""
    rows = pick(docs, doc_id=doc_id, t=text)
    rows = rows.select(F.col("doc_id").cast("long"), F.xxhash64("t").alias("h"), "t")
    items = pick(benchmark, item_id=item_id, text=item_text).filter(F.col("text").isNotNull())

    def search(part: DataFrame) -> DataFrame:
        # items of at most block_words words, see blocks()
        sent = docs.sparkSession.sparkContext.broadcast([(r[0], r[1]) for r in part.collect()])
        name = uuid.uuid4().hex

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = kept_in_process("benchmark", name, lambda: Block(sent.value, least, share))
            for batch in batches:
                out = []
                for key, h, t in zip(*(batch[c].to_pylist() for c in ("doc_id", "h", "t")), strict=True):
                    out += [(key, h, *m) for m in block.matches(t or "")]
                kinds = [f.split() for f in RESULT_SCHEMA.split(", ")]
                columns = list(zip(*out, strict=True)) or [[]] * len(kinds)
                arrays = [pa.array(c, pa.float64() if k == "double" else pa.int64()) for c, (_, k) in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, [n for n, _ in kinds])

        found = rows.mapInArrow(read, RESULT_SCHEMA)
        if len(parts) > 1:
            found = stored(found, "leaks")
            sent.destroy()
        return found

    parts = blocks(items, block_words)
    return reduce(DataFrame.union, [search(part) for part in parts])


def drop_leaked(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` into which no item leaked, all columns unchanged."""
    bad = leaks(docs, benchmark, doc_id, text, **options).select(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).distinct()
    rows = packed(docs, id=F.col(f"`{doc_id}`").cast("long"), h=F.xxhash64(F.col(f"`{text}`")))
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h"))
    return rows.join(bad, same, "left_anti").select("row.*")
