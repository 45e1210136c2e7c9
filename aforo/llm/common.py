"""What the text operators share: column selection, stored tables, shared files."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aforo.session import configure, scratch_path

#: Words are runs of anything but ASCII white space; ``bytes.split()`` cuts UTF-8 the same way.
WORD = r"[^\x20\x09-\x0D]+"


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under names of our own, so that others cannot clash."""
    return df.select(*[F.col(f"`{theirs}`").alias(ours) for ours, theirs in columns.items()])


def packed(df: DataFrame, **columns: Column) -> DataFrame:
    """Each whole row as one struct ``row`` beside columns of our own; ``select("row.*")`` brings it back."""
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return df.select(whole.alias("row"), *[c.alias(name) for name, c in columns.items()])


def ascii_lower(col: Column) -> Column:
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it again: lineage ends, sizes are known."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder or file that all executors share."""
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def new_file(folder: str, number: int, suffix: str) -> str:
    """A name that no other task attempt uses, so a retried task never touches a committed file."""
    return f"{folder}/part-{number:08d}-{uuid.uuid4().hex}.{suffix}"


def text_values(column: pa.Array) -> list[str]:
    """The texts of an Arrow column, null as empty."""
    return [t or "" for t in column.to_pylist()]


def kept_in_process(slot: str, key: str, build: Callable):
    """What ``build()`` gave for ``key``, kept by the worker process between its tasks; one value per slot."""
    held = sys.modules.setdefault("_aforo_worker", types.ModuleType("_aforo_worker")).__dict__
    if held.get(slot, (None,))[0] != key:
        held[slot] = (key, build())
    return held[slot][1]
