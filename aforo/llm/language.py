"""Language identification in two steps: the family first, then the language in it.

Texts become hashed counts of two and three bytes of their letters. A linear
support vector machine per family (one against the rest) picks the family;
within it a machine per pair of languages votes. Machines are fitted on the
driver by gradient descent on the squared hinge loss, over at most
``SAMPLE_ROWS`` labelled rows, dealt evenly to the languages: those with the
least hash of id and text, so reruns agree. This bound is what keeps the driver
small; prediction runs over all rows and whole texts.

Null text, or one without letters: ``und`` with score 0. Null label: not learned
from. Null id: learned from only if ``learn`` says so. Repeated rows count once
in the sample. Without any label every text is ``und``. A language whose family
is not known is a family of its own. Empty table: no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aforo.llm.common import pick

BINS_LOG = 12
BINS = 1 << BINS_LOG
SAMPLE_ROWS = 3000
MOST_LANGUAGES = 500
UNDECIDED = "und"
ROUNDS = 300
DECAY = 1e-4
#: Families by language code.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "uralic": "et fi hu",
    "turkic": "az kk tr tt uz",
    "indo-aryan": "bn gu hi mr ne pa ur",
    "semitic": "ar he mt",
    "celtic": "br cy ga gd",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
#: Bytes that are not part of UTF-8 letters become spaces.
BLANK = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256))
LETTER = re.compile(r"[^\W\d_]")


def byte_counts(text: str) -> np.ndarray:
    """Unit vector of the square roots of hashed byte bigram and trigram counts."""
    data = b" " + b" ".join(text.lower().encode().translate(BLANK).split()) + b" "
    counts = np.zeros(BINS, np.int64)
    for at in range(0, len(data) - 1, 1 << 20):
        b = np.frombuffer(data, np.uint8, min(len(data) - at, (1 << 20) + 2), at).astype(np.uint32)
        n = min(len(b), 1 << 20)
        two = b[:-1] * np.uint32(0x9E3779B1) + b[1:] * np.uint32(0x85EBCA77)
        three = two[:-1] + b[2:] * np.uint32(0xC2B2AE3D) + np.uint32(0x27D4EB2F)
        for codes in (two[:n], three[:n]):
            mixed = (codes ^ (codes >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            counts += np.bincount(mixed >> np.uint32(32 - BINS_LOG), minlength=BINS)
    out = np.sqrt(counts, dtype=np.float32)
    norm = np.linalg.norm(out)
    return out / norm if norm else out


def fit_machine(rows: np.ndarray, sign: np.ndarray) -> np.ndarray:
    """Weights and bias (the last, of a column of ones) of a linear machine: squared hinge loss, accelerated descent, classes balanced."""
    share = np.where(sign > 0, 0.5 / max((sign > 0).sum(), 1), 0.5 / max((sign < 0).sum(), 1)).astype(np.float32)
    weights = np.zeros(rows.shape[1], np.float32)
    ahead, t = weights, 1.0
    for _ in range(ROUNDS):
        slack = np.maximum(0, 1 - sign * (rows @ ahead))
        step = DECAY * ahead - 2 * ((share * slack * sign) @ rows)
        new = ahead - step / (4 + DECAY)
        after = (1 + (1 + 4 * t * t) ** 0.5) / 2
        ahead = new + (t - 1) / after * (new - weights)
        weights, t = new, after
    return weights


class Model:
    """Families, their machines, and a machine for every pair of languages in a family.

    A row of ``x`` is a text's features and a one for the bias.
    """

    def __init__(self, x: np.ndarray, langs: list[str]):
        lang = np.array(langs)
        self.families: dict[str, list[str]] = {}
        for code in sorted(set(langs)):
            self.families.setdefault(FAMILY_OF.get(code, code), []).append(code)
        self.names = sorted(self.families)
        family = np.array([FAMILY_OF.get(c, c) for c in langs])
        one = len(self.names) == 1
        self.rest = np.array([] if one else [fit_machine(x, np.where(family == f, 1.0, -1.0).astype(np.float32)) for f in self.names])
        self.pairs = {}
        for codes in self.families.values():
            for i, a in enumerate(codes):
                for b in codes[i + 1 :]:
                    own = (lang == a) | (lang == b)
                    self.pairs[a, b] = fit_machine(x[own], np.where(lang[own] == a, 1.0, -1.0).astype(np.float32))

    def predict(self, text: str) -> tuple[str, float]:
        if not LETTER.search(text) or not self.names:
            return UNDECIDED, 0.0
        x = np.append(byte_counts(text), np.float32(1))
        sure, family = 1.0, self.names[0]
        if len(self.names) > 1:
            margins = self.rest @ x
            best = int(margins.argmax())
            sure, family = 1 / (1 + np.exp(-4 * float(margins[best]))), self.names[best]
        codes = self.families[family]
        votes = dict.fromkeys(codes, 0.0)
        for (a, b), w in self.pairs.items():
            if a in votes and b in votes:
                p = 1 / (1 + np.exp(-4 * float(w @ x)))
                votes[a] += p
                votes[b] += 1 - p
        lang = max(codes, key=votes.get)
        within = votes[lang] / (len(codes) - 1) if len(codes) > 1 else 1.0
        return lang, float(sure * within)


def sample_labelled(rows: DataFrame, most: int = SAMPLE_ROWS) -> DataFrame:
    """At most ``most`` rows of ``(text, lang)``, as many of each language.

    Rows are counted by language first; a language with more than four times
    its part keeps the rows of the lowest hashes, twice its part on average, so
    that the exact rank is taken over few rows whatever the language's share.
    Of more than ``MOST_LANGUAGES`` labels those with the most rows are learned,
    ties by label; every document is still predicted.
    """
    hashed = rows.withColumn("_h", F.xxhash64("id", "text"))
    keys = hashed.select("lang", "_h").distinct()
    sizes = keys.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES).collect()
    keys = keys.filter(F.col("lang").isin([r["lang"] for r in sizes]))
    each = max(1, most // max(len(sizes), 1))
    span = 1 << 32
    low = F.lit(span)
    for r in sizes:
        if r["count"] > 4 * each:
            low = F.when(F.col("lang") == r["lang"], 2 * each * span // r["count"]).otherwise(low)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("_low", "_h"))
    few = keys.withColumn("_low", F.pmod("_h", F.lit(span))).filter(F.col("_low") < low)
    chosen = few.withColumn("_r", rank).filter(F.col("_r") <= each).select("lang", "_h")
    return hashed.join(F.broadcast(chosen), ["lang", "_h"]).dropDuplicates(["lang", "_h"]).select("lang", "_h", "text")


def fit(docs: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", most: int = SAMPLE_ROWS) -> Model:
    """A model from the labelled rows where ``learn`` holds; ``learn`` is a column over ``docs``."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [byte_counts(t).astype(np.float16).tobytes() for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["lang"], batch["_h"], pa.array(x, pa.binary())], ["lang", "h", "x"])

    rows = pick(docs.filter(learn), id=doc_id, text=text, lang=lang).filter("lang IS NOT NULL AND text IS NOT NULL")
    # the driver holds the sample as it came and one matrix of it, no rows as objects
    got = sample_labelled(rows, most).mapInArrow(features, "lang string, h long, x binary").toArrow()
    langs, hashes = got["lang"].to_pylist(), got["h"].to_pylist()
    order = sorted(range(len(langs)), key=lambda i: (langs[i], hashes[i]))
    place = np.argsort(np.array(order, np.int64))
    x = np.ones((len(langs), BINS + 1), np.float32)
    for to, value in zip(place, (v for chunk in got["x"].chunks for v in chunk), strict=True):
        x[to, :BINS] = np.frombuffer(value.as_buffer(), np.float16)
    return Model(x, [langs[i] for i in order])


def predict(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, lang_pred, score)`` for every row."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(t or "") for t in batch["t"].to_pylist()]
            columns = [batch["doc_id"], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score"])

    rows = pick(docs, doc_id=doc_id, t=text).withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInArrow(read, "doc_id long, lang_pred string, score double")


def filter_decided(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows whose language can be told, all columns unchanged.

    Of a model without languages: the rows whose text has letters.
    """

    @F.pandas_udf("boolean")
    def decided(texts):
        if not model.names:
            return texts.map(lambda t: bool(LETTER.search(t or "")))
        return texts.map(lambda t: model.predict(t or "")[0] != UNDECIDED)

    return docs.filter(decided(F.col(f"`{text}`")))


def bucket_of(doc_id: str, buckets: int) -> Column:
    """CRC-32 of the id as text, modulo ``buckets``; null for a null id."""
    return F.crc32(F.col(f"`{doc_id}`").cast("string")) % F.lit(buckets)
