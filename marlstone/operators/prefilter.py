"""A semi-join filter of bounded size, applied before a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 20


def likely_in(df: DataFrame, wanted: DataFrame, column: str, buckets: int = BUCKETS) -> DataFrame:
    """Rows of df whose key may be among the wanted ones: their hash bucket is.

    The broadcast side has at most `buckets` rows of eight bytes, whatever the size of
    either table, and no wanted row is lost; the exact join that follows shuffles only
    what passes. With far more keys than buckets everything passes.
    """
    bucket = F.pmod(F.xxhash64(column), F.lit(buckets)).cast("long")
    hit = wanted.select(bucket.alias("_bucket")).distinct()
    return df.withColumn("_bucket", bucket).join(F.broadcast(hit), "_bucket", "left_semi").drop("_bucket")


def without(df: DataFrame, unwanted: DataFrame, column: str, buckets: int = BUCKETS) -> DataFrame:
    """Rows of df whose key is not among the unwanted ones; only those that share a hash bucket with one are shuffled."""
    bucket = F.pmod(F.xxhash64(column), F.lit(buckets)).cast("long")
    hit = unwanted.select(bucket.alias("_bucket")).distinct()
    clear = df.withColumn("_bucket", bucket).join(F.broadcast(hit), "_bucket", "left_anti").drop("_bucket")
    return clear.unionByName(likely_in(df, unwanted, column, buckets).join(unwanted.select(column), column, "left_anti"))
