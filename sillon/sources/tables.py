"""Readers of the shared input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of an input directory, read by Spark alone."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
