"""Exports of a Slack workspace as records: joins of day files to users, channels and thread parents."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.operators.sessions import bursts, thread_replies

# Metadata files at the root, and message subtypes that are no messages.
METADATA = ("users", "channels", "groups", "mpims", "dms", "integration_logs", "canvases", "content_flags", "file_conversations")
NOTICES = (
    "channel_join", "channel_leave", "channel_archive", "channel_unarchive", "channel_name", "channel_topic", "channel_purpose",
    "pinned_item", "unpinned_item", "bot_add", "bot_remove", "reminder_add", "thread_broadcast",
)
LAST_SECOND = 8_210_266_876_799
_USERS = "id string, name string, real_name string, profile struct<display_name: string, real_name_normalized: string>"
_MESSAGES = (
    "array<struct<type: string, subtype: string, user: string, bot_id: string, username: string, ts: string, thread_ts: string, text: string, blocks: string,"
    " attachments: array<struct<title: string, text: string, pretext: string, fallback: string>>, files: array<struct<title: string, name: string, mimetype: string>>>>"
)
_MENTION = r"(<@[A-Z0-9]+>|<#[A-Z0-9]+(?:\|[^>]*)?>)"


def filled(text: Column) -> Column:
    """The text, null if it is empty."""
    return F.when(text != "", text)


def user_names(users: DataFrame) -> DataFrame:
    """id, handle, display of users (id, name, real_name, display_name, normalized).

    The handle is the display name, else the name, else the id; display is the real name
    where it says more than the handle, else null.
    """
    named = users.where("id IS NOT NULL").select("id", F.coalesce(filled(F.col("display_name")), "name", "id").alias("handle"), F.coalesce("real_name", "normalized").alias("real"))
    named = named.dropDuplicates(["id"])
    return named.select("id", "handle", F.when((F.col("real") != "") & (F.col("real") != F.col("handle")), F.col("real")).alias("display"))


def stamp_minute(ts: Column) -> Column:
    """'2016-12-28 21:22' of a Slack ts: 1970 where it is no number, the ts itself beyond the year 262142."""
    second = whole_seconds(ts)
    return F.coalesce(F.date_format(F.timestamp_seconds(F.when(F.abs(second) <= LAST_SECOND, second)), "yyyy-MM-dd HH:mm"), ts)


def whole_seconds(ts: Column) -> Column:
    """The seconds before the point of a ts, 0 where there is no number."""
    return F.coalesce(F.regexp_extract(F.coalesce(ts, F.lit("")), r"^([+-]?\d+)(?:\.|$)", 1).try_cast("long"), F.lit(0))


@F.pandas_udf(T.StringType())
def block_text(blocks: pd.Series) -> pd.Series:
    """Texts of nested blocks in order, joined; blocks nest to any depth, so they are walked."""

    def walk(items, out: list[str]) -> list[str]:
        for item in items if isinstance(items, list) else []:
            if isinstance(item, dict):
                if isinstance(item.get("text"), str):
                    out.append(item["text"])
                walk(item.get("elements"), out)
        return out

    def text(value: str | None) -> str | None:
        try:
            return "".join(walk(json.loads(value), [])) if value else None
        except (ValueError, RecursionError):
            return None

    return blocks.map(text)


def message_text(m: DataFrame) -> Column:
    """The text of a message: of its blocks, else its text, else its attachments and files."""
    said = lambda c: F.when(F.trim(c) != "", c)
    noted = F.flatten(F.transform(F.coalesce("attachments", F.array()), lambda a: F.array(*[F.trim(a[k]) for k in ("title", "text", "pretext", "fallback")])))
    noted = F.array_distinct(F.filter(noted, lambda t: t.isNotNull() & (t != "")))

    def shown(f: Column) -> Column:
        title, name, mime = filled(f["title"]), filled(f["name"]), F.coalesce(f["mimetype"], F.lit("file"))
        label = F.when(title != name, F.concat(title, F.lit(" ("), name, F.lit(")"))).otherwise(F.coalesce(title, name))
        return F.concat(F.lit("["), F.concat_ws(": ", mime, label), F.lit("]"))

    shares = F.transform(F.coalesce("files", F.array()), shown)
    return F.coalesce(said(F.col("block_text")), said(F.col("text")), F.array_join(F.concat(noted, shares), "\n"))


def resolved_mentions(messages: DataFrame, keys: list[str], text: str, names: DataFrame) -> DataFrame:
    """messages with users and channels mentioned in a text by name, and links by their label.

    names: key ('@' or '#' and the id), name. A channel's own label goes before its name;
    who or what has no name keeps the id. Only texts with mentions take part in the join.
    """
    cut = messages.withColumn("_marks", F.regexp_extract_all(text, F.lit(_MENTION), F.lit(1)))
    some = cut.where(F.size("_marks") > 0)
    marks = some.select(*keys, F.posexplode("_marks").alias("_at", "_mark"))
    key, label = F.regexp_extract("_mark", r"^<([@#][A-Z0-9]+)", 1), F.when(F.col("_mark").contains("|"), F.regexp_extract("_mark", r"\|(.*)>$", 1))
    found = marks.withColumn("key", key).join(names, "key", "left")
    shown = F.concat(F.substring("key", 1, 1), F.coalesce(label, "name", F.expr("substring(key, 2)")))
    joined = found.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("_at", shown.alias("shown")))), lambda m: m["shown"]).alias("_shown"))
    pieces = F.split(text, _MENTION, -1)
    filled_in = F.array_join(F.flatten(F.zip_with(pieces, F.concat("_shown", F.array(F.lit(""))), lambda p, s: F.array(p, s))), "")
    named = some.join(joined, keys).withColumn(text, filled_in).select(cut.columns)
    plain = named.unionByName(cut.where(F.coalesce(F.size("_marks") <= 0, F.lit(True)))).drop("_marks")
    labelled = F.regexp_replace(text, r"<https?://[^|>]+\|([^>]+)>", "$1")
    return plain.withColumn(text, F.regexp_replace(labelled, r"<(https?://[^|>]+)>", "$1"))


def rendered(body: Column) -> Column:
    """'[date #channel @handle (Display)]: body' of a message with its author's names joined."""
    display = F.when(F.col("display").isNotNull(), F.concat(F.lit(" ("), F.col("display"), F.lit(")"))).otherwise("")
    return F.concat(F.lit("["), stamp_minute(F.col("ts")), F.lit(" #"), F.col("channel"), F.lit(" @"), F.col("who"), display, F.lit("]: "), body)


def read_messages(spark: SparkSession, root: str) -> DataFrame:
    """One row per message of the day files: source_path, channel, pos and its fields; unreadable files have none."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.[jJ][sS][oO][nN]").text(root, wholetext=True)
    files = files.select(F.col("_metadata.file_path").alias("source_path"), F.from_json("value", _MESSAGES).alias("messages"))
    base = F.regexp_extract("source_path", r"([^/]+)/[^/]+$", 1)
    at_root = F.regexp_replace("source_path", r"^file:/+", "/").rlike(rf"^{_literal(root)}/(?:{'|'.join(METADATA)})\.json$")
    return files.where(~at_root).select("source_path", base.alias("channel"), F.posexplode("messages").alias("pos", "m")).where("m IS NOT NULL").select("source_path", "channel", "pos", "m.*")


def _literal(root: str) -> str:
    plain = root.removeprefix("file://").rstrip("/")
    return "".join(c if c.isalnum() or c == "/" else "\\" + c for c in plain)


def slack_records(messages: DataFrame, users: DataFrame, channels: DataFrame) -> DataFrame:
    """source_path, record_id, title, body: bursts and threads of the messages of an export.

    A record is a burst of one author, or a thread parent with its replies in the order
    of their ts; records with nothing behind the header are left out.
    """
    names = user_names(users)
    table = names.select(F.concat(F.lit("@"), "id").alias("key"), F.col("handle").alias("name")).unionByName(channels.select(F.concat(F.lit("#"), "id").alias("key"), "name").dropDuplicates(["key"]))
    place = ["source_path", "pos"]
    real = messages.where((F.col("type") == "message") & ~F.coalesce("subtype", F.lit("")).isin(*NOTICES))
    texts = real.withColumn("block_text", block_text("blocks"))
    texts = texts.withColumn("body", message_text(texts)).withColumn("ts", F.coalesce("ts", F.lit(""))).select(*place, "channel", "user", "bot_id", "username", "ts", "thread_ts", "body")
    texts = resolved_mentions(texts, place, "body", table)
    author = F.coalesce("user", "bot_id", F.lit(""))
    known = texts.withColumn("author", author).join(names.withColumnRenamed("id", "author"), "author", "left").withColumn("who", F.coalesce("handle", "username", "author"))

    own = known.where("thread_ts IS NULL OR thread_ts = ts").withColumn("is_parent", F.coalesce(F.col("thread_ts") == F.col("ts"), F.lit(False)))
    numbered = bursts(own.withColumn("user", F.coalesce("user", F.lit(""))).withColumn("second", whole_seconds(F.col("ts"))), ["source_path"], [F.col("pos")])
    first = F.row_number().over(Window.partitionBy("source_path", "burst").orderBy("pos")) == 1
    line = F.when(F.col("_first"), rendered(F.col("body"))).when(F.trim("body") != "", F.concat(F.lit("\n["), stamp_minute(F.col("ts")), F.lit("]: "), F.col("body")))
    lines = numbered.withColumn("_first", first).withColumn("line", line)
    head = F.struct("pos", "channel", "ts", "is_parent", "body", "author", "user", "who", "handle")
    whole = lines.groupBy("source_path", "burst").agg(
        F.min(head).alias("h"), F.count("*").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "").alias("body")
    )
    whole = whole.where("trim(h.body) != '' OR h.is_parent OR n > 1")

    reply = known.where("thread_ts IS NOT NULL AND thread_ts != ts AND trim(body) != ''").withColumn("line", F.concat(F.lit("\n  ↳ "), rendered(F.col("body"))))
    glued = thread_replies(reply, ["source_path"], "thread_ts", ["ts", "pos"], "line")
    out = whole.join(glued, (whole["source_path"] == glued["source_path"]) & F.col("h.is_parent") & (F.col("h.ts") == glued["thread_ts"]), "left").drop(glued["source_path"])
    body = F.concat("body", F.coalesce("replies", F.lit("")))
    handle = F.when(F.col("h.user") != "", F.coalesce("h.handle", "h.user")).otherwise("")
    title = F.concat(F.lit("@"), handle, F.lit(" in #"), F.col("h.channel"), F.lit(" on "), stamp_minute(F.col("h.ts")))
    key = F.concat(F.lit("slack:"), F.col("h.channel"), F.lit(":"), F.col("h.ts"))
    return out.select("source_path", key.alias("record_id"), title.alias("title"), body.alias("body")).where(~F.col("body").rlike(r"\]:\s*$"))


def read_slack(spark: SparkSession, root: str) -> DataFrame:
    """The records of an export folder: users.json, channels.json, and a folder of day files per channel."""
    many = lambda name, schema: spark.read.schema(schema).option("multiLine", True).json(f"{root.rstrip('/')}/{name}.json")
    users = many("users", _USERS).select("id", "name", "real_name", F.col("profile.display_name").alias("display_name"), F.col("profile.real_name_normalized").alias("normalized"))
    channels = many("channels", "id string, name string").select("id", F.coalesce("name", F.lit("")).alias("name"))
    return slack_records(read_messages(spark, root), users, channels)
