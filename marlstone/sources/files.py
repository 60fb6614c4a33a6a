"""Files and archives as tables: extraction of texts, readers of records."""

from __future__ import annotations

import csv
import email
import email.policy
import email.utils
import io
import json
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timezone
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.functions.text import collapse_whitespace, strip_html
from marlstone.operators.ranking import split_rank
from marlstone.operators.sessions import continuation_lines

EXTENSIONS = ("txt", "md", "markdown", "json", "csv", "tsv", "html", "htm", "docx")
ROWS_APART, ROWS_TOGETHER = 10_000, 50
RECORD = "source_path string, record_id string, title string, body string"


@F.pandas_udf(T.StringType())
def _pretty_json(texts: pd.Series) -> pd.Series:
    """JSON texts indented, fields by name; null for what is no JSON."""

    def pretty(text: str | None) -> str | None:
        try:
            return json.dumps(json.loads(text), indent=2, ensure_ascii=False, sort_keys=True)
        except (TypeError, ValueError):
            return None

    return texts.map(pretty)


@F.pandas_udf(T.StringType())
def _docx_text(contents: pd.Series) -> pd.Series:
    """Runs of Word documents: paragraphs on lines of their own, breaks and tabs are tabs; null if unreadable."""

    def text(content: bytes | None) -> str | None:
        try:
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                root = ElementTree.fromstring(z.read("word/document.xml"))
        except (KeyError, zipfile.BadZipFile, ElementTree.ParseError, TypeError):
            return None
        out = ""
        for k, paragraph in enumerate(n for n in root.iter() if n.tag.endswith("}p")):
            runs = ({"t": n.text or "", "tab": "\t", "br": "\t"}.get(n.tag.rpartition("}")[2], "") for n in paragraph.iter())
            out += ("\n" if k and not out.endswith("\n") else "") + "".join(runs)
        return out

    return contents.map(text)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """source_path, file_type, raw_text, sha256 of the supported files below a folder.

    Invalid bytes become replacement characters. Files without any text, unreadable JSON
    and unreadable documents are left out; equal contents have equal sha256.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return extract_texts(files)


def extract_texts(files: DataFrame) -> DataFrame:
    """The same for rows of (path, content), also of a stream."""
    kind = extension(F.col("path"))
    text = F.make_valid_utf8(F.col("content").cast("string"))
    raw = (
        F.when(kind == "json", _pretty_json(text)).when(kind.isin("html", "htm"), collapse_whitespace(strip_html(text)))
        .when(kind == "docx", _docx_text(F.col("content"))).otherwise(text)
    )
    out = files.where(kind.isin(*EXTENSIONS)).select(F.col("path").alias("source_path"), kind.alias("file_type"), raw.alias("raw_text"), F.sha2("content", 256).alias("sha256"))
    return out.where(F.col("raw_text").rlike(r"(?U)\S"))


# --- Archives: each helper yields (record_id, title, body) of one file ------------------------


def csv_records(path: str, text: str) -> Iterator[tuple[str, str, str]]:
    """Rows under their header; beyond ROWS_APART rows, ROWS_TOGETHER rows make a record."""
    kind = "tsv" if path.lower().endswith(".tsv") else "csv"
    rows = [r for r in csv.reader(io.StringIO(text), delimiter="\t" if kind == "tsv" else ",") if any(c.strip() for c in r)]
    header, name = [h.strip() for h in rows[0]] if rows else [], path.rpartition("/")[2]
    fields = lambda row: "".join(f"{header[j] if j < len(header) else f'col_{j + 1}'}: {v}\n" for j, v in enumerate(row))
    step = ROWS_TOGETHER if len(rows) - 1 > ROWS_APART else 1
    for at in range(1, len(rows), step):
        group = rows[at : at + step]
        title = f"{name} row {at}" if step == 1 else f"{name} rows {at}..{at + len(group) - 1}"
        key = f"{path}#row{at}" if step == 1 else f"{path}#rows{at}-{at + len(group) - 1}"
        body = fields(group[0]) if step == 1 else "".join(f"\n-- row {at + k} --\n{fields(row)}" for k, row in enumerate(group))
        yield key, title, f"{kind}: {title}\n{body}" if step > 1 else f"{kind}: {title}\n\n{body}"


# Message types of a channel that are no messages.
CHANNEL_NOTICES = ("ChannelPinnedMessage", "RecipientAdd", "RecipientRemove", "Call", "ChannelNameChange", "ChannelIconChange", "GuildBoost", "ThreadCreated")


def _str(value) -> str:
    return value if isinstance(value, str) else ""


def discord_records(path: str, text: str) -> Iterator[tuple[str, str, str]]:
    """Messages of a channel export with their embeds; notices and empty messages are left out."""
    data = json.loads(text)
    place = f"{data['guild']['name']}/#{data['channel']['name']}"
    for m in data.get("messages") or []:
        if m.get("type") in CHANNEL_NOTICES:
            continue
        author = _str((m.get("author") or {}).get("nickname")) or _str((m.get("author") or {}).get("name"))
        date = _str(m.get("timestamp"))[:16].replace("T", " ")
        said = _str(m.get("content")) + "".join(f"\n  embed: {e['description']}" for e in m.get("embeds") or [] if _str(e.get("description")))
        if said.strip():
            yield f"discord:{_str(m.get('id'))}", f"@{author} in {place} on {date}", f"[{date} {place} @{author}]: {said}"


def claude_records(path: str, text: str) -> Iterator[tuple[str, str, str]]:
    """Conversations of a JSON list or of one object per line, attachments with a text after their message.

    Conversations in which nothing is said are left out.
    """
    try:
        found = json.loads(text)
    except ValueError:
        found = [json.loads(line) for line in text.splitlines() if line.strip()]
    for c in found if isinstance(found, list) else [found]:
        name = c["name"] if isinstance(c.get("name"), str) else "Untitled"
        told = ""
        for m in c.get("chat_messages") or []:
            shown = {"text": lambda b: b.get("text"), "tool_use": lambda b: f"[tool_use: {b['name']}]" if _str(b.get("name")) else None}
            blocks = (shown.get(b.get("type"), lambda b: None)(b) for b in m.get("content") or [])
            said = m["text"] if isinstance(m.get("text"), str) else "".join(f"{b}\n" for b in blocks if isinstance(b, str))
            if said.strip():
                sender = _str(m.get("sender"))
                told += f"{'@' if sender in ('human', 'assistant') else ''}{sender}: {said}\n\n"
                told += "".join(f"[attachment: {_str(a.get('file_name'))}]\n{a['extracted_content']}\n\n" for a in m.get("attachments") or [] if _str(a.get("extracted_content")))
        if told:
            yield f"claude.ai:{_str(c.get('uuid'))}", f"Claude.ai: {name}", f'[claude.ai conversation: "{name}" started: {_str(c.get("created_at"))}]\n\n{told}'


def _content_text(content: dict) -> str:
    """The text of a ChatGPT message by its content type: text, code, text with images, else its first part."""
    kind, parts = content.get("content_type"), content.get("parts")
    parts = parts if isinstance(parts, list) else []
    if kind == "code":
        return f"```{_str(content.get('language'))}\n{_str(content.get('text'))}\n```"
    if kind == "text":
        return "\n".join(p for p in parts if isinstance(p, str))
    if kind == "multimodal_text":
        return "\n".join(p if isinstance(p, str) else "[image]" if isinstance(p, dict) and p.get("content_type") == "image_asset_pointer" else "" for p in parts)
    return _str(parts[0]) if parts else ""


def chatgpt_records(path: str, text: str) -> Iterator[tuple[str, str, str]]:
    """The current branch of each conversation of an export.

    Hidden, system, tool and blank messages are left out, and so are conversations without
    any other, without a current node, with a message that has no content, or whose
    parents go in a circle.
    """
    for c in json.loads(text):
        nodes, at = c.get("mapping") or {}, c.get("current_node")
        branch: list[str] = []
        while isinstance(at, str) and at not in branch:
            branch.append(at)
            at = (nodes.get(at) or {}).get("parent")
        if not branch or isinstance(at, str):
            continue
        said = []
        for node in reversed(branch):
            m = (nodes.get(node) or {}).get("message") or {}
            role = _str((m.get("author") or {}).get("role"))
            if not m or (m.get("metadata") or {}).get("is_visually_hidden_from_conversation") is True or role in ("system", "tool"):
                continue
            if "content" not in m:
                said = []
                break
            if (words := _content_text(m["content"] or {})).strip():
                said.append(f"@{role}: {words}\n\n")
        if said:
            name = c["title"] if isinstance(c.get("title"), str) else "Untitled"
            begun = int(c["create_time"]) if isinstance(c.get("create_time"), (int, float)) else 0
            try:
                date = datetime.fromtimestamp(begun, timezone.utc).strftime("%Y-%m-%d %H:%M")
            except (OverflowError, ValueError, OSError):
                date = "unknown"
            yield f"chatgpt:{_str(c.get('conversation_id'))}", f"ChatGPT: {name}", f'[chatgpt conversation: "{name}" started: {date}]\n\n' + "".join(said)


def mail_record(number: int, part: str) -> tuple[str, str, str]:
    """A mail: header block and text, of HTML mails the text between the tags."""
    mail = email.message_from_string(part, policy=email.policy.default)
    body = mail.get_body(("plain",))
    said = body.get_content() if body else ""
    if not said.strip() and (page := mail.get_body(("html",))):
        said = re.sub(r"<[^>]*>", "", page.get_content())
    name, address = next(iter(email.utils.getaddresses([str(mail["from"] or "")])), ("", ""))
    sender = f"{name} <{address}>" if name else address
    to = ", ".join(a for _, a in email.utils.getaddresses([str(mail["to"] or "")]))
    try:
        date = email.utils.parsedate_to_datetime(str(mail["date"])).isoformat()[:16]
    except (TypeError, ValueError):
        date = ""
    subject = "(no subject)" if mail["subject"] is None else str(mail["subject"])
    head = f"[{date}] From: {sender}{f' To: {to}' if to else ''}\nSubject: {subject}" + (f"\nLabels: {mail['X-Gmail-Labels']}" if mail["X-Gmail-Labels"] else "")
    key = str(mail["message-id"] or f"mbox-{number}").strip("<> ")
    return f"mbox:{key}", f"{subject} — {sender}", f"{head}\n\n{said}"


READERS = {"csv": csv_records, "discord": discord_records, "claude.ai": claude_records, "chatgpt": chatgpt_records}


def read_archive(spark: SparkSession, kind: str, path: str) -> DataFrame:
    """RECORD rows of the files of an archive; files that cannot be read give none."""
    reader = READERS[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[str, ...]] = []
            for name, text in zip(*(batch.column(c).to_pylist() for c in ("path", "text"))):
                try:
                    rows += [(name, *r) for r in reader(name, text)]
                except (ValueError, KeyError, TypeError, AttributeError, csv.Error):
                    continue
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(4)], names=["source_path", "record_id", "title", "body"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text")).mapInArrow(run, RECORD)


def read_mailbox(spark: SparkSession, path: str) -> DataFrame:
    """RECORD rows of mailboxes, mail by mail: a mailbox of any size is read in pieces.

    A mail begins at a line 'From ', which is not 'From:'. Mails of one file are numbered
    in order; what stands before the first is left out.
    """
    lines = spark.read.option("lineSep", "\nFrom ").text(path).select(F.col("_metadata.file_path").alias("source_path"), F.monotonically_increasing_id().alias("at"), "value")
    first = F.col("value").startswith("From ") & (F.row_number().over(Window.partitionBy("source_path").orderBy("at")) == 1)
    slim = lines.withColumn("first", first)
    numbered = split_rank(slim, ["source_path"], [F.col("at")], F.shiftright("at", 12), "number").where("number > 0 OR first")
    text = F.regexp_replace("value", r"^(?:From )?[^\n]*\n?", "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for source, number, part in zip(*(batch.column(c).to_pylist() for c in ("source_path", "number", "part"))):
                try:
                    rows.append((source, *mail_record(number, part)))
                except (ValueError, KeyError, TypeError, AttributeError, LookupError):
                    continue
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(4)], names=["source_path", "record_id", "title", "body"])

    skip = F.min(F.when(F.col("first"), 0).otherwise(1)).over(Window.partitionBy("source_path"))
    return numbered.select("source_path", (F.col("number") - skip).alias("number"), text.alias("part")).mapInArrow(run, RECORD)


#: Notations of the dates of a chat, the first of equally good ones is taken (fixed values).
CHAT_DATES = ("d/M/yyyy, H:mm", "M/d/yyyy, H:mm", "d/M/yy, H:mm", "M/d/yy, H:mm", "d/M/yy, H:mm:ss", "M/d/yy, H:mm:ss", "d/M/yyyy, H:mm:ss", "M/d/yyyy, H:mm:ss")
USUAL_DATE, FIRST_LINES, ENOUGH = "d/M/yy, H:mm", 200, 50
_HEAD = r"^(?:\[([^\]]*)\] ?|(.*?) - )"


def chat_date_notation(lines: DataFrame, group: str, line: str, text: str) -> DataFrame:
    """group, notation: the notation that reads most dates of the first lines of a chat, and never one before the last.

    It must read two at least; a chat without such a notation has no row.
    """
    stamp = F.coalesce(*[F.when(F.regexp_extract(text, _HEAD, k) != "", F.regexp_extract(text, _HEAD, k)) for k in (1, 2)])
    tried = lines.where(F.col(line) < FIRST_LINES).select(group, line, F.posexplode(F.array(*map(F.lit, CHAT_DATES))).alias("rank", "notation"), stamp.alias("stamp"))
    read = tried.withColumn("at", F.coalesce(*[F.when(F.col("rank") == k, F.try_to_timestamp("stamp", F.lit(f))) for k, f in enumerate(CHAT_DATES)])).where("at IS NOT NULL")
    w = Window.partitionBy(group, "rank").orderBy(line)  # at most FIRST_LINES rows
    steps = read.withColumn("n", F.row_number().over(w)).withColumn("back", F.col("at") < F.lag("at").over(w)).where(F.col("n") <= ENOUGH)
    sound = steps.groupBy(group, "rank", "notation").agg(F.count("*").alias("n"), F.max(F.coalesce("back", F.lit(False))).alias("back")).where("NOT back AND n >= 2")
    return sound.groupBy(group).agg(F.max_by("notation", F.struct("n", -F.col("rank"))).alias("notation"))


def read_whatsapp(spark: SparkSession, path: str) -> DataFrame:
    """RECORD rows of chat texts; lines that no one sent are left out, but count in the numbering."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source_path"), "value")
    lines = files.select("source_path", F.posexplode(F.split(F.regexp_replace("value", r"[\x{feff}\x{200e}\r]|\n\z", ""), "\n")).alias("line", "text"))
    joined = continuation_lines(lines, ["source_path"], "line", "text", r"^\[?\d{1,4}[/.-]\d{1,2}[/.-]\d{1,4},? \d{1,2}:\d{2}")
    head = r"(?s)^\[?([^\]\-]+?)(?:\]| -) ([^:\n]+): (.*)$"
    part = lambda k: F.regexp_extract("body", head, k)
    said = joined.withColumn("number", F.col("message") - 1).where(F.col("body").rlike(head)).select("source_path", "number", part(1).alias("stamp"), part(2).alias("sender"), part(3).alias("text"))
    dated = said.join(chat_date_notation(lines, "source_path", "line", "text"), "source_path", "left").withColumn("notation", F.coalesce("notation", F.lit(USUAL_DATE)))
    at = F.coalesce(*[F.when(F.col("notation") == f, F.try_to_timestamp("stamp", F.lit(f))) for f in CHAT_DATES])
    chat = F.regexp_replace(F.regexp_extract(F.url_decode("source_path"), r"([^/]+?)(?:\.[^./]*)?$", 1), "^(?:WhatsApp Chat with )+", "")
    rows = dated.withColumn("at", at).where("at IS NOT NULL").withColumn("date", F.date_format("at", "yyyy-MM-dd HH:mm")).withColumn("chat", chat)
    key = F.concat(F.lit("whatsapp:"), F.col("chat"), F.lit(":"), F.col("number").cast("string"), F.lit(":"), F.unix_seconds("at").cast("string"))
    title = F.concat(F.lit("@"), F.col("sender"), F.lit(" in "), F.col("chat"), F.lit(" on "), F.col("date"))
    body = F.concat(F.lit("["), F.col("date"), F.lit(" chat:"), F.col("chat"), F.lit(" @"), F.translate("sender", " ", "_"), F.lit("]: "), F.col("text"))
    return rows.select("source_path", key.alias("record_id"), title.alias("title"), body.alias("body"))
