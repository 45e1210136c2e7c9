"""A reproducible pseudo-random number per key.

Plain 64-bit integer arithmetic, so that samples and splits do not depend on
partitioning, row order or engine.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

MODULUS = 2_147_483_647  # 2^31 - 1, prime
MULTIPLIERS = (48_271, 69_621, 16_807, 39_373, 62_089)


def _as_number(c: Column) -> Column:
    """Whole numbers written as text are themselves; other texts are read from their MD5."""
    text = c.cast("string")
    number = F.when(~text.contains("."), text.try_cast("long"))
    return F.coalesce(number, F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long"))


def key_hash(keys: Sequence[str | Column], seed: int = 42, df: DataFrame | None = None) -> Column:
    """Integer in [0, MODULUS) from key columns; nulls count as -1.

    Whole numbers, also as text, count as they are; other keys by the first
    eight hexadecimal digits of the MD5 of their text. With ``df``, columns of a
    whole-number type are known and never made text.
    """
    if len(keys) > len(MULTIPLIERS):
        raise ValueError("too many key columns")
    whole = {f.name for f in df.schema.fields if isinstance(f.dataType, IntegralType)} if df is not None else set()
    total = F.lit(seed).cast("long")
    for key, mult in zip(keys, MULTIPLIERS):
        c = F.col(key) if isinstance(key, str) else key
        number = c.cast("long") if isinstance(key, str) and key in whole else _as_number(c)
        residue = F.pmod(F.coalesce(number, F.lit(-1).cast("long")), F.lit(MODULUS).cast("long"))
        total = total + residue * F.lit(mult)
    h = total % MODULUS
    # the square breaks the lattice a linear form has on consecutive ids
    return (h * h + h * F.lit(12_345)) % MODULUS


def key_hash_sql(keys: Sequence[str], seed: int = 42) -> str:
    """The same number as SQL text for keys that are no negative numbers."""
    number = "COALESCE(TRY_CAST({k} AS BIGINT), CAST(('0x' || SUBSTR(MD5(CAST({k} AS VARCHAR)), 1, 8)) AS BIGINT))"
    terms = " + ".join(f"({number.format(k=k)} % {MODULUS}) * {m}" for k, m in zip(keys, MULTIPLIERS))
    h = f"(({seed} + {terms}) % {MODULUS})"
    return f"(({h} * {h} + {h} * 12345) % {MODULUS})"
