"""Tables by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of ``folder``; columns and filters are pushed into its scan by Catalyst."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
