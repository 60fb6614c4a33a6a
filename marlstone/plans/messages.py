"""Queries over texts and message logs, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions.chunking import chunk_record, chunk_text
from marlstone.functions.text import approximate_tokens, canonical_source, collapse_whitespace, derive_title, humanize_bytes, strip_html
from marlstone.operators import sessions
from marlstone.sources import slack
from marlstone.tables import table


def approx_tokens(spark, base):
    return table(spark, base, "documents").select("doc_id", approximate_tokens(F.coalesce("text", F.lit(""))).alias("tokens"))


def humanized_sizes(spark, base):
    return table(spark, base, "documents").select("doc_id", humanize_bytes(F.coalesce(F.octet_length("text"), F.lit(0))).alias("size"))


def derived_titles(spark, base):
    return table(spark, base, "documents").select("doc_id", derive_title(F.col("text")).alias("title"))


def canonical_sources(spark, base):
    return table(spark, base, "documents").select("doc_id", canonical_source(F.col("title"), F.col("doc_id").cast("string")).alias("source"))


def stripped_html(spark, base):
    d = table(spark, base, "documents").where("file_type = 'html' AND text IS NOT NULL")
    return d.select("doc_id", strip_html(F.col("text")).alias("plain"))


def collapsed_html(spark, base):
    d = table(spark, base, "documents").where("file_type = 'html' AND text IS NOT NULL")
    return d.select("doc_id", collapse_whitespace(strip_html(F.col("text"))).alias("plain"))


def chunked_documents(spark, base):
    """Every document in overlapping chunks of paragraphs."""
    d = table(spark, base, "documents").select("doc_id", F.posexplode(chunk_text(F.col("text"))).alias("chunk_index", "c"))
    return d.select("doc_id", "chunk_index", "c.text", "c.char_start", "c.char_end")


def chunked_records(spark, base):
    """Every archive record in chunks that repeat its header."""
    r = table(spark, base, "records").select("rec_key", F.posexplode(chunk_record(F.col("body"))).alias("chunk_index", "text"))
    return r.select("rec_key", "chunk_index", "text")


def _events(spark, base):
    e = table(spark, base, "events")
    return e.select(
        "event_id", "event_type", F.col("user_id").cast("string").alias("user"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("second"),
        (F.col("event_type") == "error").alias("is_parent"), "ts",
    )


def burst_sessions(spark, base):
    """Bursts of each day of the event log, an error counting as the beginning of a thread."""
    days = _events(spark, base).withColumn("day", F.floor(F.col("second") / 86400))
    return sessions.bursts(days, ["day"], [F.col("ts"), F.col("event_id")]).select("event_id", "day", "burst")


def burst_texts(spark, base):
    days = _events(spark, base).withColumn("day", F.floor(F.col("second") / 86400))
    numbered = sessions.bursts(days, ["day"], [F.col("ts"), F.col("event_id")])
    return sessions.burst_bodies(numbered, ["day"], ["ts", "event_id"], "event_type")


def continued_messages(spark, base):
    """Chat documents as messages: lines without a '[' header go on with the one before."""
    d = table(spark, base, "documents").where("file_type = 'slack' AND text IS NOT NULL")
    lines = d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    return sessions.continuation_lines(lines, ["doc_id"], "line", "text", r"^\[\d{4}-")


def stall_detect(spark, base):
    """Events of a user that repeat type and properties of the event before."""
    e = table(spark, base, "events").withColumn("call", F.concat_ws(" ", "event_type", "props"))
    return sessions.stalls(e, ["user_id"], [F.col("ts"), F.col("event_id")], "call").where("stalled").select("event_id", "user_id")


def thread_replies(spark, base):
    """Replies to each message of chat_messages that has any, in the order of their stamp texts."""
    m = table(spark, base, "chat_messages").select("conversation_uuid", "parent_uuid", F.coalesce("created_at", F.lit("")).alias("created_at"), "row_id", F.concat(F.lit("\n> "), F.col("row_id").cast("string")).alias("line"))
    return sessions.thread_replies(m, ["conversation_uuid"], "parent_uuid", ["created_at", "row_id"], "line")


def _slack_log(spark, base):
    """The Slack rows of message_log as messages, and the users as an export has them."""
    log = table(spark, base, "message_log").where("kind = 'slack'")
    rows = log.select("msg_key", "channel", F.col("user_ref").alias("author"), F.coalesce("ts", F.lit("")).alias("ts"), F.coalesce("msg_text", F.lit("")).alias("body"), "subtype")
    users = table(spark, base, "slack_users").select(F.col("user_id").alias("id"), F.col("handle").alias("name"), "real_name", "display_name", F.lit(None).cast("string").alias("normalized"))
    return rows, users


def slack_lines(spark, base):
    """Each Slack message as a rendered line, notices left out; mentions by name."""
    rows, users = _slack_log(spark, base)
    names = slack.user_names(users)
    said = rows.where(~F.coalesce("subtype", F.lit("")).isin(*slack.NOTICES))
    said = slack.resolved_mentions(said, ["msg_key"], "body", names.select(F.concat(F.lit("@"), "id").alias("key"), F.col("handle").alias("name")))
    known = said.withColumn("author", F.coalesce("author", F.lit(""))).join(names.withColumnRenamed("id", "author"), "author", "left").withColumn("who", F.coalesce("handle", "author"))
    return known.withColumn("channel", F.coalesce("channel", F.lit(""))).select("msg_key", slack.rendered(F.col("body")).alias("line"))


def slack_users_named(spark, base):
    """Handle and display name of every user."""
    return slack.user_names(_slack_log(spark, base)[1])


def csv_rows_render(spark, base):
    """Customers as rendered records, one per row, numbered by key."""
    c = table(spark, base, "customer")
    body = F.concat(F.lit("csv: customer row "), F.col("c_custkey").cast("string"), F.lit("\n\nname: "), F.col("c_name"), F.lit("\nsegment: "), F.col("c_mktsegment"), F.lit("\n"))
    return c.select(F.concat(F.lit("customer.csv#row"), F.col("c_custkey").cast("string")).alias("record_id"), body.alias("body"))


def csv_grouped(spark, base):
    """Customers rendered fifty to a record."""
    c = table(spark, base, "customer").withColumn("part", F.floor(F.col("c_custkey") / 50))
    row = F.concat(F.lit("-- row "), F.col("c_custkey").cast("string"), F.lit(" --\nname: "), F.col("c_name"))
    lines = F.sort_array(F.collect_list(F.struct("c_custkey", row.alias("row"))))
    return c.groupBy("part").agg(F.count("*").alias("n"), F.array_join(F.transform(lines, lambda x: x["row"]), "\n").alias("body"))


def revenue_by_nation(spark, base):
    """Extra: a star join, its revenue per nation and year."""
    li, o, c, n = (table(spark, base, t) for t in ("lineitem", "orders", "customer", "nation"))
    j = li.join(o, li["l_orderkey"] == o["o_orderkey"]).join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"])
    return j.groupBy("n_name", F.year("o_orderdate").alias("year")).agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


_DAY = "WITH e AS (SELECT *, epoch(date_trunc('second', ts))::BIGINT AS second, (epoch(date_trunc('second', ts))::BIGINT // 86400) AS day, event_type = 'error' AS is_parent FROM events), l AS (SELECT *, lag(user_id) OVER w AS pu, lag(second) OVER w AS ps, lag(is_parent) OVER w AS pp FROM e WINDOW w AS (PARTITION BY day ORDER BY ts, event_id)), b AS (SELECT *, sum(CASE WHEN pu = user_id AND abs(second - ps) < 90 AND NOT is_parent AND NOT pp THEN 0 ELSE 1 END) OVER (PARTITION BY day ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT - 1 AS burst FROM l)"
_SLACK = """WITH u AS (SELECT id, handle, CASE WHEN real_name <> '' AND real_name <> handle THEN real_name END AS display FROM
 (SELECT user_id AS id, coalesce(nullif(display_name, ''), handle, user_id) AS handle, real_name FROM slack_users)),
 m AS (SELECT msg_key, channel, user_ref, msg_text AS told, ts, coalesce(try_cast(nullif(regexp_extract(coalesce(ts, ''), '^([+-]?[0-9]+)([.]|$)', 1), '') AS BIGINT), 0) AS second
 FROM message_log WHERE kind = 'slack' AND coalesce(subtype, '') NOT IN ('channel_join', 'channel_leave', 'channel_archive', 'channel_unarchive', 'channel_name', 'channel_topic', 'channel_purpose', 'pinned_item', 'unpinned_item', 'bot_add', 'bot_remove', 'reminder_add', 'thread_broadcast')),
 d AS (SELECT *, CASE WHEN abs(second) <= 8210266876799 THEN make_timestamp(second * 1000000) END AS moment FROM m),
 said AS (SELECT *, CASE WHEN moment IS NULL THEN ts ELSE CASE WHEN year(moment) > 9999 THEN '+' ELSE '' END || strftime(moment, '%Y-%m-%d %H:%M') END AS minute FROM d)"""
_SIZE = "octet_length(encode(coalesce(text, '')))"
# What stands after the first '>' of each piece behind a '<'; a piece without one is all tag.
_NO_CODE = "regexp_replace(regexp_replace(text, '<script[^>]*>.*?</script[^>]*>', '', 'gis'), '<style[^>]*>.*?</style[^>]*>', '', 'gis')"
_STRIP = f"replace(array_to_string(list_transform(string_split('>' || {_NO_CODE}, '<'), lambda x: CASE WHEN contains(x, '>') THEN substr(x, strpos(x, '>') + 1) ELSE '' END), ''), '>', '')"
_SPACE = "[\\s\\x0b\\x{85}\\p{Z}]+"


def _lines(text: str) -> str:
    """The trimmed lines of a text that hold anything, in SQL."""
    trimmed = f"regexp_replace(s, '^{_SPACE}|{_SPACE}$', '', 'g')"
    return f"list_filter(list_transform(regexp_split_to_array({text}, '\\r?\\n'), lambda s: {trimmed}), lambda s: s <> '')"


ORACLES = {
    "approx_tokens": f"SELECT doc_id, ({_SIZE} // 4)::BIGINT AS tokens FROM documents",
    "humanized_sizes": f"SELECT doc_id, CASE WHEN {_SIZE} >= 1048576 THEN printf('%.1f MB', {_SIZE} / 1048576.0) WHEN {_SIZE} >= 1024 THEN printf('%.1f KB', {_SIZE} / 1024.0) ELSE printf('%.1f B', {_SIZE}::DOUBLE) END AS size FROM documents",
    "canonical_sources": "SELECT doc_id, CASE WHEN trim(coalesce(title, '')) = '' THEN 'mcp://note/' || doc_id::VARCHAR WHEN contains(title, '://') THEN trim(title) ELSE 'mcp://' || trim(title) END AS source FROM documents",
    "stripped_html": f"SELECT doc_id, {_STRIP} AS plain FROM documents WHERE file_type = 'html' AND text IS NOT NULL",
    "derived_titles": f"WITH t AS (SELECT doc_id, {_lines("coalesce(text, '')")}[1] AS line FROM documents) SELECT doc_id, CASE WHEN line IS NULL THEN '(untitled)' WHEN length(line) > 80 THEN left(line, 77) || '...' ELSE line END AS title FROM t",
    "collapsed_html": f"WITH h AS (SELECT doc_id, {_STRIP} AS plain FROM documents WHERE file_type = 'html' AND text IS NOT NULL), l AS (SELECT doc_id, {_lines('plain')} AS lines FROM h) SELECT doc_id, CASE WHEN len(lines) > 0 THEN array_to_string(lines, chr(10)) || chr(10) ELSE '' END AS plain FROM l",
    "burst_sessions": f"{_DAY} SELECT event_id, day, burst FROM b",
    "burst_texts": f"{_DAY} SELECT day, burst, count(*) AS n, string_agg(event_type, chr(10) ORDER BY ts, event_id) AS body FROM b GROUP BY day, burst",
    "continued_messages": "WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE file_type = 'slack' AND text IS NOT NULL), u AS (SELECT doc_id, unnest(ls) AS text, generate_subscripts(ls, 1) AS line FROM s), m AS (SELECT *, (count(*) FILTER (regexp_matches(text, '^\\[\\d{4}-')) OVER (PARTITION BY doc_id ORDER BY line ROWS UNBOUNDED PRECEDING))::BIGINT AS message FROM u) SELECT doc_id, message, count(*) AS n_lines, string_agg(text, chr(10) ORDER BY line) AS body FROM m WHERE message > 0 GROUP BY doc_id, message",
    "stall_detect": "WITH c AS (SELECT event_id, user_id, event_type || ' ' || props AS call, lag(event_type || ' ' || props) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events) SELECT event_id, user_id FROM c WHERE call = prev",
    "thread_replies": "SELECT conversation_uuid, parent_uuid, count(*) AS n_replies, string_agg(chr(10) || '> ' || row_id::VARCHAR, '' ORDER BY coalesce(created_at, ''), row_id) AS replies FROM chat_messages WHERE parent_uuid IS NOT NULL GROUP BY ALL",
    "slack_lines": f"{_SLACK} SELECT msg_key, '[' || minute || ' #' || coalesce(channel, '') || ' @' || coalesce(u.handle, user_ref, '') || CASE WHEN u.display IS NULL THEN '' ELSE ' (' || u.display || ')' END || ']: ' || coalesce(told, '') AS line FROM said LEFT JOIN u ON u.id = user_ref",
    "slack_users_named": f"{_SLACK} SELECT id, handle, display FROM u",
    "csv_rows_render": "SELECT 'customer.csv#row' || c_custkey::VARCHAR AS record_id, 'csv: customer row ' || c_custkey::VARCHAR || chr(10) || chr(10) || 'name: ' || c_name || chr(10) || 'segment: ' || c_mktsegment || chr(10) AS body FROM customer",
    "csv_grouped": "SELECT (c_custkey // 50)::BIGINT AS part, count(*) AS n, string_agg('-- row ' || c_custkey::VARCHAR || ' --' || chr(10) || 'name: ' || c_name, chr(10) ORDER BY c_custkey) AS body FROM customer GROUP BY 1",
    "revenue_by_nation": "SELECT n_name, year(o_orderdate)::INT AS year, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL",
}
QUERIES = {name: globals()[name] for name in (*ORACLES, "chunked_documents", "chunked_records")}
