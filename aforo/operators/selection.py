"""Exact rank selection without sorting: digit by digit, by counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from aforo.functions.hashing import MODULUS

LOW_BITS, DIGIT = 15, 16  # a 31-bit hash is two digits


def _slices(value: Column) -> list[Column]:
    """Four 16-bit digits of a 64-bit number, unsigned; null before all."""
    return [F.coalesce(F.shiftrightunsigned(value, at).bitwiseAND((1 << DIGIT) - 1), F.lit(-1)) for at in (48, 32, 16, 0)]


def _digits(df: DataFrame, hash_col: str, ties: Sequence[str]) -> list[Column]:
    """The order of :func:`smallest` as digits of at most 65,536 values each."""
    h = F.col(hash_col).cast("long")
    out = [F.shiftright(h, LOW_BITS), h.bitwiseAND((1 << LOW_BITS) - 1)]
    for c in ties:
        if not isinstance(df.schema[c].dataType, IntegralType):
            break
        # flipping the sign bit makes signed order unsigned
        out += _slices(F.col(c).cast("long").bitwiseXOR(F.lit(-(1 << 63))))
    return out + (_slices(F.xxhash64(*ties)) if ties else [])


def smallest(df: DataFrame, hash_col: str, n: int, ties: Sequence[str]) -> DataFrame:
    """The n rows with the smallest hash; equal hashes go by the whole-number columns that ``ties`` begins with,
    then by a hash of all its columns.

    Radix selection: a histogram of the first digit (at most 65,536 counts, which
    the driver sees) tells where the n-th row lies, one of the next digit among
    the rows that share it goes on, until a digit's rows are wanted whole. Two
    digits are enough unless hashes are equal. No row is sorted or moved, so
    neither equal hashes nor a repeated key gather rows in a task. Rows equal in
    all ``ties`` come together. The result is a plain filter; ``df`` is read once
    for each digit, so store what is dear to compute.
    """
    if n <= 0:
        return df.limit(0)
    taken, here, left = F.lit(False), F.lit(True), n
    for digit in _digits(df, hash_col, ties):
        counts = df.filter(here).groupBy(digit.alias("_d")).agg(F.count(F.lit(1)).alias("_c")).collect()
        for at, count in sorted((r["_d"], r["_c"]) for r in counts):
            if count >= left:
                break
            left -= count
        else:
            return df  # fewer than n rows
        taken, here = taken | (here & (digit < at)), here & (digit == at)
        if count == left:
            break
    return df.filter(taken | here)


def hash_share(hash_col: str, share: float):
    """True for about the given share of keys."""
    return F.col(hash_col) < int(share * MODULUS)
