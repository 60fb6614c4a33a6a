"""What a path holds, told by names and first bytes, and its ingest by the reader that fits."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.session import file_system
from marlstone.sources.files import read_archive, read_files, read_mailbox, read_whatsapp
from marlstone.sources.slack import read_slack
from marlstone.store import Store
from marlstone.streaming.watch import to_tables

SNIFFED = 4096
# Files that mark the export folder of a kind, and the file that holds its records.
FOLDERS = {
    "slack": (("users.json", "channels.json"), ""),
    "chatgpt": (("conversations.json", "message_feedback.json", "user.json"), "conversations.json"),
    "claude.ai": (("conversations.json", "users.json", "projects.json"), "conversations.json"),
}
_CHAT_NAME = re.compile(r"(?:_chat|whatsapp chat with .*)\\.txt", re.IGNORECASE | re.DOTALL)
_CHAT_LINE = re.compile(r"^\u200e?\\[?\\d{1,4}[/.-]\\d{1,2}[/.-]\\d{1,4},? \\d{1,2}:\\d{2}", re.MULTILINE)


def _head(spark: SparkSession, path: str) -> str:
    """The first bytes of a file as text."""
    fs, at = file_system(spark, path)
    row = spark.read.format("binaryFile").load(str(at(path))).select(F.substring("content", 1, SNIFFED).alias("head")).first()
    return bytes(row["head"]).decode("utf-8", "replace") if row else ""


def file_kind(name: str, head: Callable[[], str]) -> str | None:
    """mbox, whatsapp, discord or csv by a file's name and first bytes, the first that fits; null for other files."""
    small = name.lower()
    if small.endswith(".mbox") or not re.search(r"\\.\\w+$", small) and head()[:64].startswith("From "):
        return "mbox"
    if _CHAT_NAME.fullmatch(name) and _CHAT_LINE.search(head()):
        return "whatsapp"
    if small.endswith(".json") and all(f'"{word}"' in head() for word in ("guild", "channel", "messages")):
        return "discord"
    return "csv" if small.endswith((".csv", ".tsv")) else None


def detect(spark: SparkSession, path: str) -> tuple[str, str] | None:
    """(kind, path of its records) of an archive; null for plain files and folders. A missing path raises.

    Only the names in the root of a folder are listed, and of a file its first bytes are read.
    """
    fs, at = file_system(spark, path)
    if not fs.exists(at(path)):
        raise FileNotFoundError(path)
    root = path.rstrip("/")
    if not fs.getFileStatus(at(path)).isDirectory():
        kind = file_kind(root.rpartition("/")[2], lambda: _head(spark, path))
        return (kind, path) if kind else None
    names = sorted(s.getPath().getName() for s in fs.listStatus(at(path)) if s.isFile())
    for kind, (marks, file) in FOLDERS.items():
        if all(m in names for m in marks):
            return kind, f"{root}/{file}".rstrip("/")
    return None


def read_records(spark: SparkSession, kind: str, path: str) -> DataFrame:
    """source_path, record_id, title, body of an archive of a kind."""
    readers = {"slack": read_slack, "whatsapp": read_whatsapp, "mbox": read_mailbox}
    return readers[kind](spark, path) if kind in readers else read_archive(spark, kind, path)


def ingest_path(spark: SparkSession, path: str, store: Store, embedding: Callable[[Column], Column] | None = None, collection: int | None = None) -> int:
    """Store an archive, a file or a folder of files; the number of documents added.

    Contents that the store has are not added again, so a path may be ingested anew after
    any change: changed files become documents of their own.
    """
    after = (store.read("documents").agg(F.max("ingest_seq")).first()[0] or 0) + 1
    if found := detect(spark, path):
        kind, at = found
        return store.ingest_records(read_records(spark, kind, at), kind, embedding, collection, after)
    return store.ingest(*to_tables(read_files(spark, path), after, embedding), collection)
