"""Token-ID output: documents as token ids in word-aligned Simple-8b files.

A 64-bit word holds a 4-bit selector and 60 bits of ids; the selector says how
many ids of how many bits follow. Ids that need more than 60 bits stand in a
list of exceptions, and an escape word names their place there. Every block of
``BLOCK`` ids begins with a new word whose number is kept, so blocks can be
decoded apart; all words of one selector are decoded at once.

A file is a run of chunks, each complete in itself: sizes, document ids,
document lengths (packed too), block offsets, exceptions, words. The index has
a row per chunk with its byte range, so a reader seeks and reads one range.

Documents are dealt by ranges of ``(id, hash of the text)``, hence files and
chunks in order hold ascending ids (null first). Repeated rows are all kept,
an empty or null text is the end id alone, an empty table has no chunks. One
document is never cut: memory is bounded by ``CHUNK_IDS`` and the longest text.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aforo.llm.common import kept_in_process, new_file, open_fs, pick, stored, text_values
from aforo.session import scratch_path

#: Fixed values of the format: ids in a word, and bits of an id, by selector; 15 is the escape.
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
ESCAPE = 15
BLOCK = 16_384
CHUNK_IDS = 1 << 19
MAGIC = b"S8BCHNK1"
HEADER = "<8s5Q"
CACHE_PIECES = 600_000

INDEX_SCHEMA = "file string, part long, chunk long, offset long, length long, docs long, ids long, before long"


def run_of(small: np.ndarray, count: int) -> np.ndarray:
    """Where ``count`` true values in a row begin."""
    have = 1
    while have < count:
        more = min(have, count - have)
        small = small[:-more] & small[more:]
        have += more
    return small


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, number of the first word of each block, and exceptions of unsigned 64-bit ids."""
    ids = np.asarray(ids, np.uint64)
    n = len(ids)
    selector = np.full(n, 13, np.int8)
    large = ids >= np.uint64(1 << 60)
    room = np.minimum(BLOCK - np.arange(n) % BLOCK, n - np.arange(n))
    room = np.minimum(room, int(COUNTS[0])).astype(np.int8)
    for s in range(12, -1, -1):
        count = int(COUNTS[s])
        if count > n:
            break
        fits = run_of(ids < np.uint64(1 << int(BITS[s])), count) & (room[: n - count + 1] >= count)
        if not fits.any() and count * 2 < BLOCK:
            break
        np.copyto(selector[: n - count + 1], np.int8(s), where=fits)
    selector[large] = ESCAPE
    step = np.append(COUNTS, [1, 1])[selector].tolist()
    starts, at = [], 0
    while at < n:
        starts.append(at)
        at += step[at]
    first = np.array(starts, np.int64)
    chosen = selector[first] if n else selector
    words = np.zeros(len(first), np.uint64)
    for s in range(14):
        own = np.flatnonzero(chosen == s)
        if len(own):
            place = np.arange(COUNTS[s])
            parts = ids[first[own][:, None] + place] << (place * BITS[s]).astype(np.uint64)
            words[own] = np.bitwise_or.reduce(parts, axis=1) | np.uint64(s << 60)
    own = np.flatnonzero(chosen == ESCAPE)
    words[own] = np.arange(len(own), dtype=np.uint64) | np.uint64(ESCAPE << 60)
    blocks = np.searchsorted(first, np.arange(0, n, BLOCK))
    return words, blocks.astype(np.uint32), ids[first[own]] if len(own) else ids[:0]


def unpack(words: np.ndarray, exceptions: np.ndarray) -> np.ndarray:
    """The ids of words; any run of whole blocks may be given."""
    chosen = (words >> np.uint64(60)).astype(np.int64)
    count = np.append(COUNTS, [1, 1])[chosen]
    end = np.cumsum(count)
    out = np.empty(int(end[-1]) if len(end) else 0, np.uint64)
    for s in range(14):
        own = np.flatnonzero(chosen == s)
        if len(own):
            place = np.arange(COUNTS[s])
            mask = np.uint64((1 << int(BITS[s])) - 1)
            values = (words[own][:, None] >> (place * BITS[s]).astype(np.uint64)) & mask
            out[(end[own] - COUNTS[s])[:, None] + place] = values
    own = np.flatnonzero(chosen == ESCAPE)
    out[end[own] - 1] = exceptions[(words[own] & np.uint64((1 << 60) - 1)).astype(np.int64)]
    return out


def chunk_bytes(doc_ids: list, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    words, blocks, exceptions = pack(ids)
    sizes = pack(lengths)[0]
    null = np.array([d is None for d in doc_ids], np.uint8)
    known = np.array([0 if d is None else d for d in doc_ids], np.int64)
    head = struct.pack(HEADER, MAGIC, len(doc_ids), len(sizes), len(blocks), len(exceptions), len(words))
    return b"".join([head, *(a.tobytes() for a in (known, null, sizes, blocks, exceptions, words))])


def read_chunk(data: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """Document ids, lengths and ids of a chunk."""
    magic, docs, sizes, blocks, exceptions, words = struct.unpack_from(HEADER, data)
    if magic != MAGIC:
        raise ValueError("not a chunk of token ids")
    at, parts = struct.calcsize(HEADER), []
    for n, kind in ((docs, np.int64), (docs, np.uint8), (sizes, np.uint64), (blocks, np.uint32),
                    (exceptions, np.uint64), (words, np.uint64)):
        parts.append(np.frombuffer(data, kind, n, at))
        at += parts[-1].nbytes
    known, null, packed, _, odd, body = parts
    doc_ids = [None if x else d for d, x in zip(known.tolist(), null.tolist(), strict=True)]
    return doc_ids, unpack(packed, odd[:0]), unpack(body, odd)


#: Letters and digits below are those of the safe characters only; a text with others is encoded whole.
UNSAFE = re.compile("[^\t\n\r -~¡-ɏ‐-‧€]")
LETTER = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
DIGIT = "0-9²³¹¼-¾"
PIECE = re.compile(
    rf"'(?:[stmd]|re|ve|ll)| ?[{LETTER}]+| ?[{DIGIT}]+| ?[^\t\n\r {LETTER}{DIGIT}]+|[\t\n\r ]+(?![^\t\n\r ])|[\t\n\r ]+"
)


def cuts_plainly(part) -> bool:
    """Whether a pre-tokenizer cuts as :data:`PIECE` does and adds nothing."""
    return type(part).__name__ == "ByteLevel" and part.use_regex and not part.add_prefix_space


def merges_plainly(model) -> bool:
    """Whether a model merges the same way at each call, all letters alike."""
    odd = ("dropout", "ignore_merges", "byte_fallback", "continuing_subword_prefix", "end_of_word_suffix")
    return type(model).__name__ == "BPE" and not any(getattr(model, name) for name in odd)


def byte_letters() -> dict[int, str]:
    """The letter of each byte in a byte-level vocabulary: printable ones their own, others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Growing:
    """An array that grows at its end without being copied each time."""

    def __init__(self, kind: type):
        self.held, self.size = np.empty(1024, kind), 0

    def extend(self, values: np.ndarray) -> None:
        end = self.size + len(values)
        if end > len(self.held):
            held = np.empty(max(end, 2 * len(self.held)), self.held.dtype)
            held[: self.size] = self.held[: self.size]
            self.held = held
        self.held[self.size : end] = values
        self.size = end


class PieceEncoder:
    """A byte-level BPE that encodes each distinct piece of text once.

    Merges never cross the pieces that the tokenizer cuts a text into, so the
    ids of a text are those of its pieces in order. Other tokenizers, or a
    byte-level one that is set to cut or merge otherwise, encode every text whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = t = Tokenizer.from_file(path)
        self.added = [a.content for a in t.get_added_tokens_decoder().values()]
        self.pieces = t.normalizer is None and cuts_plainly(t.pre_tokenizer) and merges_plainly(t.model)
        self.letters = byte_letters()
        self.clear()

    def clear(self) -> None:
        self.number: defaultdict = defaultdict()
        self.number.default_factory = self.number.__len__
        self.start, self.count, self.flat = Growing(np.int64), Growing(np.int64), Growing(np.uint32)

    def direct(self, text: str) -> bool:
        return not self.pieces or UNSAFE.search(text) is not None or any(a in text for a in self.added)

    def shown(self, piece: str) -> str:
        """A piece in the letters of the vocabulary."""
        if piece.isascii() and piece.isprintable():  # only the blank has another letter
            return piece.replace(" ", self.letters[0x20])
        return piece.encode().decode("latin-1").translate(self.letters)

    def learn(self, pieces: list[str]) -> None:
        merge = self.tokenizer.model.tokenize
        got = [[t.id for t in merge(self.shown(p))] for p in pieces]
        count = np.fromiter(map(len, got), np.int64, len(got))
        self.start.extend(self.flat.size + np.cumsum(count) - count)
        self.count.extend(count)
        self.flat.extend(np.fromiter(chain.from_iterable(got), np.uint32, int(count.sum())))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.number) > CACHE_PIECES:
            self.clear()
        whole = [self.direct(t) for t in texts]
        pieces = [[] if w else PIECE.findall(t) for t, w in zip(texts, whole, strict=True)]
        counts = [len(p) for p in pieces]
        known = len(self.number)
        index = np.fromiter(map(self.number.__getitem__, chain.from_iterable(pieces)), np.int64, sum(counts))
        if fresh := list(islice(reversed(self.number), len(self.number) - known)):
            self.learn(fresh[::-1])
        size = self.count.held[index]
        end = np.cumsum(size)
        out = self.flat.held[np.repeat(self.start.held[index] - (end - size), size) + np.arange(size.sum())]
        cut = np.concatenate([[0], end])[np.cumsum([0, *counts])]
        return [
            np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32) if w else out[a:b]
            for t, w, a, b in zip(texts, whole, cut[:-1], cut[1:], strict=True)
        ]


def piece_encoder(path: str) -> Callable[[list[str]], list[np.ndarray]]:
    """The encoder of this worker process, kept between its tasks."""
    return kept_in_process("tokenizer", path, lambda: PieceEncoder(path)).encode


def write_token_files(
    docs: DataFrame, encoder: Callable, end_id: int, folder: str, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Write the files and return their index, a row per chunk.

    ``encoder()`` is called in each task and gives a function from texts to
    arrays of ids. A file's name is new for every attempt of a task and the
    index, which names the committed ones, is stored: a lost executor costs a
    rerun and leaves at most a file that no index names.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(), TaskContext.get().partitionId()
        fs, _ = open_fs(folder)
        out, name, rows, offset, before = None, new_file(folder, part, "s8b"), [], 0, 0
        keys: list = []
        held: list[np.ndarray] = []

        def flush():
            nonlocal out, offset, before, keys, held
            if not keys:
                return
            if out is None:
                fs.create_dir(open_fs(folder)[1], recursive=True)
                out = fs.open_output_stream(open_fs(name)[1], compression=None)
            ids = np.concatenate(held)
            data = chunk_bytes(keys, np.array([len(h) for h in held], np.uint64), ids)
            out.write(data)
            rows.append((name, part, len(rows), offset, len(data), len(keys), len(ids), before))
            offset, before, keys, held = offset + len(data), before + len(ids), [], []

        end = np.array([end_id], np.uint64)
        size = 0
        for batch in batches:
            for lo in range(0, len(batch), 256):
                piece = batch.slice(lo, 256)
                for key, ids in zip(piece["k"].to_pylist(), encode(text_values(piece["t"])), strict=True):
                    keys.append(key)
                    held.append(np.concatenate([ids.astype(np.uint64), end]))
                    size += len(held[-1])
                    if size >= CHUNK_IDS:
                        flush()
                        size = 0
        flush()
        if out is not None:
            out.close()
        names = [f.split()[0] for f in INDEX_SCHEMA.split(", ")]
        columns = list(zip(*rows, strict=True)) or [[]] * len(names)
        kinds = [pa.string() if n == "file" else pa.int64() for n in names]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    rows = pick(docs, k=doc_id, t=text).withColumn("k", F.col("k").cast("long"))
    rows = rows.withColumn("_h", F.xxhash64("t"))
    ordered = rows.repartitionByRange("k", "_h").sortWithinPartitions("k", "_h").select("k", "t")
    return stored(ordered.mapInArrow(write, INDEX_SCHEMA), "token-index")


def with_starts(index: DataFrame) -> DataFrame:
    """Add ``start``, the ids in all chunks before; the window runs over a row per file."""
    files = index.groupBy("part").agg(F.sum("ids").alias("_ids"))
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("part", F.coalesce(F.sum("_ids").over(upto), F.lit(0)).alias("_base"))
    return index.join(files, "part").withColumn("start", F.col("_base") + F.col("before")).drop("_base")


def read_token_files(index: DataFrame) -> DataFrame:
    """A row per document of the files: doc_id, start, n_tokens, ids_crc32, position in its chunk.

    ``index`` comes from :func:`with_starts`; each chunk is one range read.
    """
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, path = open_fs(row["file"])
                with fs.open_input_file(path) as f:
                    doc_ids, lengths, ids = read_chunk(f.read_at(row["length"], row["offset"]))
                body = ids.astype("<u4").tobytes()
                end = np.cumsum(lengths.astype(np.int64))
                start = end - lengths.astype(np.int64)
                crc = [zlib.crc32(body[4 * a : 4 * b]) for a, b in zip(start.tolist(), end.tolist(), strict=True)]
                arrays = [pa.array(doc_ids, pa.int64()), pa.array(start + row["start"]), pa.array(end - start)]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    # a number keeps the small index from being merged into one task
    tasks = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return index.repartition(tasks, "file", "chunk").mapInArrow(read, schema)


def token_ids(
    docs: DataFrame, tokenizer: str, end_id: int = 0, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Encode ``docs`` to files in the scratch folder and read back a row per document."""
    spark: SparkSession = docs.sparkSession
    folder = scratch_path(spark, "token-files")
    index = write_token_files(docs, lambda: piece_encoder(tokenizer), end_id, folder, doc_id, text)
    return read_token_files(with_starts(index))
