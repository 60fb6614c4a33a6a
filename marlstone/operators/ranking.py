"""Row numbers within groups that may be too large for one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def split_rank(df: DataFrame, group: list[str], order: list[Column], slices: Column, name: str) -> DataFrame:
    """Add the number of each row within its group, from 0, in the given order.

    `slices` cuts a group into consecutive pieces: a row of a smaller slice must come
    before every row of a larger one. Rows are numbered within (group, slice), and the
    numbers of rows before each slice come from one small row per slice, so that no task
    holds more than one slice of a group. Null slices come first.
    """
    df = df.withColumn("_slice", slices)
    inner = Window.partitionBy(*group, "_slice").orderBy(*order)
    local = df.withColumn("_local", F.row_number().over(inner))
    sizes = df.groupBy(*group, "_slice").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy(F.col("_slice").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.where("_n > 0").select(*[F.col(g).alias(f"_g_{g}") for g in group], F.col("_slice").alias("_s"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    same = F.col("_slice").eqNullSafe(F.col("_s"))
    for g in group:
        same = same & (F.col(g) == F.col(f"_g_{g}"))
    joined = local.join(starts, same)
    keep = [c for c in df.columns if c != "_slice"]
    return joined.select(*keep, (F.col("_local") - 1 + F.col("_before")).cast("long").alias(name))
