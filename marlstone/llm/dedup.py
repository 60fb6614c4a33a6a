"""Queries of problem 1: repeated messages, batch after batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.vector_cells import VectorCells
from marlstone.session import scratch
from marlstone.tables import table


def p1_found(spark: SparkSession, base: str) -> DataFrame:
    """kept_key, dup_key of each rejected row and the accepted row it repeats.

    The table holds all batches; they are appended to a new index in one call, which gives
    the rows of one call per batch.
    """
    rows = table(spark, base, "records").select("rec_key", "record_id", "body", "batch_id")
    index = VectorCells(spark, scratch(spark, "vector-cells"))
    index.append(rows)
    index.close()
    return index.found()


def p1_repeats_per_source(spark: SparkSession, base: str) -> DataFrame:
    """Rows and rejected rows per file type and batch."""
    rows = table(spark, base, "records").select("rec_key", "file_type", "batch_id")
    dups = p1_found(spark, base).select(F.col("dup_key").alias("rec_key"), F.lit(1).alias("hit"))
    return rows.join(dups, "rec_key", "left").groupBy("file_type", "batch_id").agg(F.count("*").alias("n_rows"), F.count("hit").alias("n_repeats"))


QUERIES = {"p1_found": p1_found, "p1_repeats_per_source": p1_repeats_per_source}
ORACLES: dict[str, str] = {}
