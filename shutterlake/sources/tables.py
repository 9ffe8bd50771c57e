"""Readers of the Parquet tables of a library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table; only the columns and row groups that a query uses are read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
