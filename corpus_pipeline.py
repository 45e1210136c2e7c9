"""A training corpus from raw documents: each stage reads what the one before has stored.

1. Language ID drops documents whose language cannot be told (no letters, no text).
2. SimHash near-dedup keeps the document with the least id of each group.
3. Decontamination drops documents that hold at least half of a benchmark item.
4. Mixing repeats or drops documents so that sources come near their targets.
5. Token files hold the mix; the result has a row per document read back from them.

Rows with null columns pass every stage that does not reject them for their
text. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aforo.llm import decontam, language, mixing, simhash, tokenfile
from aforo.llm.common import stored, table
from aforo.llm.queries import tokenizer_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told, by a model of their own labels."""
    return language.filter_decided(docs, language.fit(docs, F.lit(True)))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no item of the benchmark leaked."""
    return decontam.drop_leaked(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    quality = mixing.fitted_quality(docs, table(spark, sf_dir, "labels"))
    return mixing.repeat_rows(docs, mixing.mix(docs, quality=quality))


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix; a row per document read back from them."""
    return tokenfile.token_ids(docs, tokenizer_path())


STAGES: list[tuple[str, Stage]] = [
    ("language", identify_language),
    ("near duplicates", drop_near_copies),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("token files", write_tokens),
]

#: SQL has no tokenizer, so the last stage cannot be expressed.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"stage-{name.replace(' ', '-')}")
    return docs
