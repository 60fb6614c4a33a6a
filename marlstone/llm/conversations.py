"""Queries of problem 5: conversations in order with roles."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import threads
from marlstone.operators.timezones import normalise_stamps
from marlstone.session import cut_lineage
from marlstone.tables import table


def chat_turns(spark: SparkSession, base: str) -> DataFrame:
    """The kept turns of chat_messages: conv, turn, ref, speaker."""
    rows = table(spark, base, "chat_messages").where(F.col("conversation_uuid").isNotNull())
    rows = rows.select("row_id", "conversation_uuid", "message_uuid", "parent_uuid", "idx", "sender", "text", "created_at", "export_tz", "received_at")
    slim = rows.select(
        F.col("conversation_uuid").alias("conv"),
        F.coalesce("message_uuid", F.concat(F.lit("row "), F.col("row_id").cast("string"))).alias("msg"),
        F.col("row_id").alias("ref"), F.col("parent_uuid").alias("parent"), F.col("idx").cast("long").alias("idx"),
        threads.role_of(F.col("sender")).alias("role"), threads.is_blank(F.col("text")).alias("blank"),
        "created_at", "export_tz", "received_at",
    )
    messages = cut_lineage(threads.latest_messages(slim), "messages")
    # Stamps are read where neither places nor parents are stated: nowhere else they tell the order.
    timed = lambda silent: normalise_stamps(silent, "created_at", "export_tz").withColumnRenamed("utc_micros", "at")
    positions = threads.conversation_positions(messages, timed).drop("msg")
    return threads.kept_turns(cut_lineage(positions, "positions")).withColumn("ref", F.col("ref").cast("string"))


def tree_turns(spark: SparkSession, base: str) -> DataFrame:
    """The kept turns of chatgpt_conversations: conv (row_id as text), turn, ref (node), speaker.

    The path runs from current_node through the parents to the root. Each conversation is
    one record, so its path is walked within the row.
    """
    rows = table(spark, base, "chatgpt_conversations").select("row_id", "conversation")
    paths = rows.mapInArrow(_paths, "row_id bigint, pos bigint, ref string, role string, blank boolean")
    positions = paths.select(F.col("row_id").cast("string").alias("conv"), "ref", threads.role_of(F.col("role")).alias("role"), "blank", "pos")
    return threads.kept_turns(cut_lineage(positions, "paths"))


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The path of each record."""
    for batch in batches:
        rows = [(key, *step) for key, text in zip(batch.column("row_id").to_pylist(), batch.column("conversation")) for step in threads.tree_path(text.as_py())]
        columns = [list(c) for c in zip(*rows)] or [[]] * len(_PATH)
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, _PATH.types)], schema=_PATH)


_PATH = pa.schema([("row_id", pa.int64()), ("pos", pa.int64()), ("ref", pa.string()), ("role", pa.string()), ("blank", pa.bool_())])


def p5_found(spark: SparkSession, base: str) -> DataFrame:
    """tab, conv_key, turn, msg_ref, speaker of every conversation kept."""
    shape = lambda df, tab: df.select(F.lit(tab).alias("tab"), F.col("conv").alias("conv_key"), "turn", F.col("ref").alias("msg_ref"), "speaker")
    return shape(chat_turns(spark, base), "chat_messages").unionByName(shape(tree_turns(spark, base), "chatgpt_conversations"))


def p5_threads(spark: SparkSession, base: str) -> DataFrame:
    """msg_key, channel_key, thread, depth: the interleaved channels of message_log as link trees.

    Rows whose stamp is unreadable stand for themselves; of several rows with equal
    channel, author, stamp and text each is a message of its own.
    """
    log = table(spark, base, "message_log")
    rows = log.select("msg_key", F.concat_ws("/", "kind", "channel").alias("channel"), "user_ref", "msg_text", "ts", "export_tz", F.when(F.col("kind") == "whatsapp", F.col("source_path")).alias("path"))
    timed = normalise_stamps(rows, "ts", "export_tz", group=F.col("path"))
    messages = timed.select(F.col("msg_key").alias("msg"), "channel", (F.col("utc_micros") / 1e6).alias("at"), F.col("user_ref").alias("author"), F.col("msg_text").alias("text"))
    links = cut_lineage(threads.candidate_links(messages), "links")
    # Links go back in time within one channel, so no tree is deeper than its channel has rows.
    longest = links.groupBy("channel").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    depths = threads.tree_depths(links.select(F.col("msg").alias("node"), "parent"), [], longest)
    return links.join(depths.withColumnRenamed("node", "msg"), "msg").select(
        F.col("msg").alias("msg_key"), F.col("channel").alias("channel_key"), F.col("root").alias("thread"), F.col("depth").cast("int").alias("depth")
    )


QUERIES = {"p5_found": p5_found, "p5_threads": p5_threads}
ORACLES: dict[str, str] = {}
