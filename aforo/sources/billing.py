"""Scans of the billing fact table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, MapType, VariantType

from aforo.functions.hashing import key_hash
from aforo.functions.rows import present
from aforo.operators.selection import smallest
from aforo.session import stored


#: Types that have no order.
UNORDERED = (MapType, VariantType, VectorUDT)


def parquet_scan(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def projected_scan(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Only the listed columns that exist; pruning reaches the Parquet reader."""
    return df.select(*present(df, columns))


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows"))


def limit_rows(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """First n rows in key order (a reproducible head)."""
    return df.orderBy(*order).limit(n)


def sample_rows(df: DataFrame, n: int, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """min(n, rows) rows drawn by the hash of the key, on executors only.

    Rows of one key are told apart by a hash of their columns, so that a repeated
    key cannot enlarge the sample; rows equal in every column come together. Hashes of
    keys that are no whole numbers are dear and read several times, so they are stored.
    """
    others = [f.name for f in df.schema.fields if f.name not in keys and not isinstance(f.dataType, UNORDERED)]
    hashed = df.withColumn("_h", key_hash(keys, seed, df))
    if not all(isinstance(df.schema[k].dataType, IntegralType) for k in keys):
        hashed = stored(hashed, "hashed-keys")
    return smallest(hashed, "_h", n, ties=[*keys, *others]).drop("_h")
