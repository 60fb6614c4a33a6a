"""Reading the store's Parquet tables by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """The table `name` below the folder `base`."""
    return spark.read.parquet(f"{base}/{name}.parquet")
