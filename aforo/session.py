"""Session settings and the shared scratch folder."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
#: Rows of a narrow table that one task of a repeated pass takes.
ROWS_PER_TASK = 50_000


def configure(spark: SparkSession) -> SparkSession:
    """Runtime SQL settings the operators rely on; safe to call more than once."""
    # year()/month() of zone-less timestamps must not depend on the machine.
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    # Unit-level aggregates hold far more than the default 128 keys per task
    # before falling back to sorting.
    spark.conf.set("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", "65536")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and scratch tables.

    A cluster names it in ``spark.checkpoint.dir``. Only a local master may
    fall back to a temporary folder, since other machines could not read it.
    """
    sc = spark.sparkContext
    folder = spark.conf.get(CHECKPOINT_CONF, None) or sc.getCheckpointDir()
    if folder is None:
        if not sc.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="aforo-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for one scratch table in the shared folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/aforo/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a scratch table and read again: computed once, lineage cut, size known."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_for_passes(df: DataFrame, name: str, keys: Sequence[str]) -> DataFrame:
    """A stored narrow table laid out for models that read it hundreds of times; persist the result.

    A pass has one task for each ``ROWS_PER_TASK`` rows instead of one for each partition of
    the wide rows that made them: a small table costs one task a pass, and what
    tasks send to the driver grows with the rows only. ``keys`` are unique or nearly
    so; rows lie in their order, so that seeded models agree on every run.
    """
    table = stored(df, name)
    tasks = max(1, math.ceil(table.count() / ROWS_PER_TASK))
    return table.repartition(tasks, *keys).sortWithinPartitions(*keys)


def remove_folder(spark: SparkSession, path: str) -> bool:
    """Delete a folder of the shared file system; False if there was none."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True))
