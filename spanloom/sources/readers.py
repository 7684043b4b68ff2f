"""Batch readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Parquet table ``name`` under ``folder``."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
