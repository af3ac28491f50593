"""Parquet tables of a directory by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` stored under ``folder`` as one parquet file or directory."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
