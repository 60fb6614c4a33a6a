"""Message logs: bursts, thread replies, continuation lines, stalls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GAP_SECONDS = 90


def bursts(messages: DataFrame, group: list[str], order: list[Column], user: str = "user", second: str = "second", parent: str = "is_parent") -> DataFrame:
    """Add `burst`, the number of the burst within the group, from 0.

    A message goes on with the burst if its user is that of the message before it and not
    empty, less than GAP_SECONDS apart, and neither of the two begins a thread.
    """
    w = Window.partitionBy(*group).orderBy(*order)
    before = lambda c: F.lag(c).over(w)
    goes_on = (
        (F.col(user) != "") & (before(user) == F.col(user)) & (F.abs(F.col(second) - before(second)) < GAP_SECONDS)
        & ~F.col(parent) & ~before(parent)
    )
    marked = messages.withColumn("_new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1))
    return marked.withColumn("burst", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("_new")


def burst_bodies(numbered: DataFrame, group: list[str], order: list[str], text: str) -> DataFrame:
    """group, burst, n, body: the texts of each burst in order, one line each."""
    ordered = F.sort_array(F.collect_list(F.struct(*order, text)))
    return numbered.groupBy(*group, "burst").agg(F.count("*").alias("n"), F.array_join(F.transform(ordered, lambda m: m[text]), "\n").alias("body"))


def thread_replies(replies: DataFrame, group: list[str], parent: str, order: list[str], line: str) -> DataFrame:
    """group, parent, n_replies, replies: the lines of the replies to each parent in order, joined.

    Replies with a null parent belong to none.
    """
    ordered = F.sort_array(F.collect_list(F.struct(*order, line)))
    told = replies.where(F.col(parent).isNotNull()).groupBy(*group, parent)
    return told.agg(F.count("*").alias("n_replies"), F.array_join(F.transform(ordered, lambda m: m[line]), "").alias("replies"))


def continuation_lines(lines: DataFrame, group: list[str], position: str, text: str, header: str) -> DataFrame:
    """Messages of a chat text: a line without a header goes on with the message before it.

    Lines before the first header of a group are dropped. Result: group, message, n_lines, body.
    """
    w = Window.partitionBy(*group).orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    numbered = lines.withColumn("message", F.sum(F.when(F.coalesce(F.col(text).rlike(header), F.lit(False)), 1).otherwise(0)).over(w)).where("message > 0")
    ordered = F.sort_array(F.collect_list(F.struct(position, text)))
    return numbered.groupBy(*group, "message").agg(F.count("*").alias("n_lines"), F.array_join(F.transform(ordered, lambda m: m[text]), "\n").alias("body"))


def stalls(calls: DataFrame, group: list[str], order: list[Column], fingerprint: str) -> DataFrame:
    """Add `stalled`: the call repeats the one before it."""
    w = Window.partitionBy(*group).orderBy(*order)
    return calls.withColumn("stalled", F.coalesce(F.lag(fingerprint).over(w) == F.col(fingerprint), F.lit(False)))
