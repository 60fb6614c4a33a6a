"""Queries of problem 2: nested conversation records as related flat tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators import conversations_json as cj
from marlstone.session import cut_lineage
from marlstone.tables import table


def _shredded(spark: SparkSession, base: str) -> DataFrame:
    """Level columns of all conversations, written once as the tables are built from them."""
    return cut_lineage(cj.shred_conversations(table(spark, base, "chatgpt_conversations"), "conversation", ["row_id"]), "shred")


def p2_found(spark: SparkSession, base: str) -> DataFrame:
    """row_id, item_kind, item_id, parent_ref of every node, part and attachment."""
    return cj.flat_items(_shredded(spark, base), "row_id")


def p2_items_per_row(spark: SparkSession, base: str) -> DataFrame:
    """Items of each kind per conversation row."""
    return cj.flat_items(_shredded(spark, base), "row_id").groupBy("row_id", "item_kind").agg(F.count("*").alias("n_items"))


QUERIES = {"p2_found": p2_found, "p2_items_per_row": p2_items_per_row}
ORACLES: dict[str, str] = {}
