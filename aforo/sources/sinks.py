"""Writers and the checks made after writing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parquet_sink(df: DataFrame, path: str, level: int = 3, mode: str = "error") -> str:
    """Zstandard Parquet."""
    (
        df.write.mode(mode)
        .option("compression", "zstd")
        .option("parquet.compression.codec.zstd.level", level)
        .parquet(path)
    )
    return path


def sink_verify(spark: SparkSession, path: str, source: DataFrame) -> DataFrame:
    """Rows in, rows read back, and how much the aggregation reduced them."""
    rows_out = spark.read.parquet(path).count()
    return source.agg(F.count(F.lit(1)).alias("rows_in")).select(
        "rows_in",
        F.lit(rows_out).cast("long").alias("rows_out"),
        F.try_divide(F.col("rows_in").cast("double"), F.lit(rows_out)).alias("reduction"),
    )


def csv_sink(df: DataFrame, path: str, mode: str = "error") -> str:
    """One CSV file with a header; for small reports."""
    df.coalesce(1).write.mode(mode).option("header", True).csv(path)
    return path


def result_json_sink(document: DataFrame, path: str, mode: str = "append") -> str:
    """One JSON document per row; each call adds a file, as each run adds a result."""
    document.coalesce(1).write.mode(mode).json(path)
    return path
