"""Queries of problem 3: every readable stamp as one instant in UTC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators.timezones import normalise_stamps
from marlstone.tables import table


def _all_stamps(spark: SparkSession, base: str) -> DataFrame:
    none = F.lit(None).cast("string")
    log = table(spark, base, "message_log").select(
        F.lit("message_log").alias("tab"), F.col("msg_key").alias("row_key"), F.col("ts").alias("stamp"), "export_tz",
        F.when(F.col("kind") == "whatsapp", F.coalesce("source_path", F.lit(""))).alias("path"), F.lit(False).alias("is_float"),
    )
    chat = table(spark, base, "chat_messages").select(
        F.lit("chat_messages").alias("tab"), F.col("row_id").alias("row_key"), F.col("created_at").alias("stamp"), "export_tz",
        none.alias("path"), F.lit(False).alias("is_float"),
    )
    made = F.get_json_object("conversation", "$.create_time")
    gpt = table(spark, base, "chatgpt_conversations").select(
        F.lit("chatgpt_conversations").alias("tab"), F.col("row_id").alias("row_key"), made.alias("stamp"), none.alias("export_tz"),
        none.alias("path"), made.contains("E").alias("is_float"),
    )
    return log.unionByName(chat).unionByName(gpt)


def _normalised(spark: SparkSession, base: str) -> DataFrame:
    return normalise_stamps(_all_stamps(spark, base), "stamp", "export_tz", group=F.col("path"), rounded=F.col("is_float"))


def p3_found(spark: SparkSession, base: str) -> DataFrame:
    """tab, row_key, utc_micros of each readable stamp of the three tables."""
    return _normalised(spark, base).where(F.col("utc_micros").isNotNull()).select("tab", "row_key", "utc_micros")


def p3_zone_cases(spark: SparkSession, base: str) -> DataFrame:
    """How many stamps of each table were stated, direct, ambiguous, nonexistent, utc, epoch or unreadable."""
    case = F.coalesce("zone_case", F.lit("unreadable")).alias("zone_case")
    return _normalised(spark, base).groupBy("tab", case).agg(F.count("*").alias("n_stamps"))


QUERIES = {"p3_found": p3_found, "p3_zone_cases": p3_zone_cases}
ORACLES: dict[str, str] = {}
