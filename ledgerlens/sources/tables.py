"""Reader for Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

def read_table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """``{base}/{name}.parquet`` — one (read-only) driver table."""
    return spark.read.parquet(f"{base.rstrip('/')}/{name}.parquet")
