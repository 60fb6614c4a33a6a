"""Exported conversation trees (one JSON per row) as flat node, part and attachment tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.operators.shred import node_arrays, rebuild, shred

LEAVES = {
    "node": "mapping.*",
    "parent": "mapping.*.parent",
    "child": "mapping.*.children.[]",
    "part": "mapping.*.message.content.parts.[]",
    "text": "mapping.*.message.content.text",
    "attachment": "mapping.*.message.metadata.attachments.[]",
}


def shred_conversations(df: DataFrame, column: str, keep: list[str], more: dict[str, str] | None = None) -> DataFrame:
    """Level columns of the paths that the tables below are built from."""
    return shred(df, column, LEAVES | (more or {}), keep)


def listed_parents(shredded: DataFrame, key: str) -> DataFrame:
    """key, child, listed: the node whose children list a node, for rows where one has no parent field.

    Where several nodes list it, the first in the record stands.
    """
    missing = F.exists(node_arrays(shredded, "node", "parent"), lambda n: (n["parent_d"] < 3) & n["node"].isNotNull())
    children = rebuild(shredded.where(missing).withColumn("_at", F.lit(0)), [key], "child", 4, "node")
    order = F.monotonically_increasing_id()
    return (
        children.where(F.col("value").isNotNull()).withColumn("_o", order)
        .groupBy(key, F.col("value").alias("child"))
        .agg(F.min_by("parent", "_o").alias("listed"))
    )


def nodes(shredded: DataFrame, key: str) -> DataFrame:
    """key, node, parent ('' if none): one row per entry of the mapping.

    A node without a `parent` field gets the node whose children list it; a null parent
    is none. The parent need not exist. Rows that are no JSON or have no mapping give no
    rows.
    """
    flat = shredded.where("is_json").select(key, F.inline(node_arrays(shredded, "node", "parent")).alias("node", "parent", "node_d", "parent_d"))
    flat = flat.where(F.col("node_d") == 2).select(key, "node", "parent", (F.col("parent_d") == 3).alias("has_field"))
    stated = flat.where("has_field").select(key, "node", F.coalesce("parent", F.lit("")).alias("parent"))
    silent = flat.where(~F.col("has_field")).join(
        listed_parents(shredded, key).withColumnRenamed("child", "node"), [key, "node"], "left"
    )
    return stated.unionByName(silent.select(key, "node", F.coalesce("listed", F.lit("")).alias("parent")))


def parts(shredded: DataFrame, key: str) -> DataFrame:
    """key, node, part: entries of a message's parts that are not null, by their number.

    A bare string in place of the list counts as its only entry, and so does `text` where
    there are no parts.
    """
    listed = rebuild(shredded, [key], "part", 6, "node").where(F.col("value").isNotNull())
    plain = shredded.where("is_json").select(
        key, F.inline(F.arrays_zip(F.col("node.v").alias("node"), F.col("text.v").alias("text"), F.col("text.d").alias("d")))
    )
    # `parts` at level 5 or more: the field is there; its first entry per node tells.
    has_parts = rebuild(shredded, [key], "part", 5, "node").where(F.col("item") == 0).select(key, F.col("parent").alias("node"))
    texts = plain.where((F.col("d") == 5) & F.col("text").isNotNull()).join(has_parts, [key, "node"], "left_anti")
    return listed.select(key, F.col("parent").alias("node"), F.col("item").alias("part")).unionByName(
        texts.select(key, "node", F.lit(0).alias("part"))
    )


def attachments(shredded: DataFrame, key: str) -> DataFrame:
    """key, node, attachment: each entry of a message's metadata.attachments by its number."""
    return rebuild(shredded, [key], "attachment", 6, "node").select(key, F.col("parent").alias("node"), F.col("item").alias("attachment"))


def flat_items(shredded: DataFrame, key: str) -> DataFrame:
    """The three tables as one: key, item_kind, item_id, parent_ref."""
    numbered = lambda df, kind, col: df.select(key, F.lit(kind).alias("item_kind"), F.concat_ws("#", "node", col).alias("item_id"), F.col("node").alias("parent_ref"))
    tree = nodes(shredded, key).select(key, F.lit("node").alias("item_kind"), F.col("node").alias("item_id"), F.col("parent").alias("parent_ref"))
    return tree.unionByName(numbered(parts(shredded, key), "part", "part")).unionByName(numbered(attachments(shredded, key), "attachment", "attachment"))
