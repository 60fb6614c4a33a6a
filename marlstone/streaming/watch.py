"""Watched folders: files that arrive are extracted and stored once per content."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from marlstone.functions.chunking import chunk_text
from marlstone.functions.text import file_stem
from marlstone.sources.files import extract_texts
from marlstone.store import Store, chunk_rows

Embedding = Callable[[Column], Column]


def to_tables(texts: DataFrame, after: int = 0, embedding: Embedding | None = None) -> tuple[DataFrame, DataFrame]:
    """Documents and chunks of extracted texts; ids follow from path and content, the title from the file's name."""
    ids = F.sha2(F.concat_ws("\u0000", "source_path", "sha256"), 256)
    documents = texts.select(
        ids.alias("document_id"), "source_path", "file_type", file_stem(F.col("source_path")).alias("title"), "raw_text",
        F.current_timestamp().alias("ingested_at"), "sha256", (F.lit(after) + F.xxhash64("source_path").bitwiseAND((1 << 40) - 1)).alias("ingest_seq"),
    )
    parts = documents.select("document_id", F.posexplode(chunk_text(F.col("raw_text"))).alias("chunk_index", "c")).select("document_id", "chunk_index", "c.*")
    return documents, chunk_rows(parts, F.col("char_start"), F.col("char_end"), embedding)


def watch(spark: SparkSession, folder: str, store: Store, checkpoint: str, once: bool = False, embedding: Embedding | None = None, collection: int | None = None) -> StreamingQuery:
    """Ingest what arrives in a folder; a replayed or copied content is stored once.

    A file is read when it appears. One that is changed in place is read again by ingest_path().
    """
    schema = "path string, modificationTime timestamp, length long, content binary"
    stream = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).load(folder)

    def ingest(batch: DataFrame, number: int) -> None:
        store.ingest(*to_tables(extract_texts(batch), number << 41, embedding), collection)

    writer = stream.writeStream.foreachBatch(ingest).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
