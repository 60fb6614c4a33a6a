"""Catalogue queries: sources, documents, records, tags, collections, totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.text import ascii_lower, contains_folded, humanize_bytes

SOURCE_ORDERS = {"name": None, "date": "ingested_at", "chunks": "chunk_count", "records": "record_count"}


def clamp(value: int, low: int, high: int) -> int:
    """A page bound within its limits."""
    return max(low, min(high, value))


def _members(collection: DataFrame | None, documents: DataFrame) -> DataFrame:
    return documents if collection is None else documents.join(collection.select("document_id"), "document_id", "left_semi")


def chunk_counts(chunks: DataFrame) -> DataFrame:
    """document_id, chunk_count."""
    return chunks.groupBy("document_id").agg(F.count("*").alias("chunk_count"))


def list_sources(documents: DataFrame, chunks: DataFrame, q: str = "", file_type: str | None = None, collection: DataFrame | None = None) -> DataFrame:
    """path, file_type, record_count, chunk_count, ingested_at per source path.

    q is part of the path, case of ASCII letters ignored; '' filters nothing.
    """
    docs = _members(collection, documents)
    if q:
        docs = docs.where(contains_folded(F.col("source_path"), q))
    if file_type:
        docs = docs.where(F.col("file_type") == file_type)
    counted = docs.join(chunk_counts(chunks), "document_id", "left")
    return counted.groupBy(F.col("source_path").alias("path")).agg(
        F.min("file_type").alias("file_type"),
        F.count("*").alias("record_count"),
        F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("chunk_count"),
        F.max("ingested_at").alias("ingested_at"),
    )


def ordered_page(rows: DataFrame, by: str | None, ties: list[str], limit: int, offset: int = 0) -> DataFrame:
    """A page of 1 to 1000 rows, by a falling column if given, then by the ties."""
    first: list[Column] = [F.col(by).desc()] if by else []
    return rows.orderBy(*first, *ties).offset(max(0, offset)).limit(clamp(limit, 1, 1000))


def list_documents(documents: DataFrame, chunks: DataFrame, memberships: DataFrame, q: str = "", collection: DataFrame | None = None) -> DataFrame:
    """document_id, source_path, title, file_type, chunk_count, ingested_at, collection_ids."""
    docs = _members(collection, documents)
    if q:
        docs = docs.where(contains_folded(F.col("source_path"), q) | contains_folded(F.col("title"), q))
    ids = memberships.groupBy("document_id").agg(F.sort_array(F.collect_set("collection_id")).alias("collection_ids"))
    out = docs.join(chunk_counts(chunks), "document_id", "left").join(ids, "document_id", "left")
    return out.select(
        "document_id", "source_path", "title", "file_type", F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), "ingested_at",
        F.coalesce("collection_ids", F.array().cast("array<bigint>")).alias("collection_ids"),
    )


def records_by_source(documents: DataFrame, path: str) -> DataFrame:
    """document_id, title, text, ingested_at of one source path; pages follow ingest_seq."""
    return documents.where(F.col("source_path") == path).select("document_id", "title", F.col("raw_text").alias("text"), "ingested_at", "ingest_seq")


def get_document(documents: DataFrame, key: str) -> DataFrame:
    """The first document whose path or id is key."""
    return documents.where((F.col("source_path") == key) | (F.col("document_id").cast("string") == key)).orderBy("ingest_seq").limit(1)


def list_file_types(documents: DataFrame) -> DataFrame:
    """file_type, source_count."""
    return documents.groupBy("file_type").agg(F.count_distinct("source_path").alias("source_count"))


def list_tags(tags: DataFrame) -> DataFrame:
    """tag, document_count."""
    return tags.groupBy("tag").agg(F.count_distinct("document_id").alias("document_count"))


def list_collections(collections: DataFrame, memberships: DataFrame) -> DataFrame:
    """id, name, document_count of every collection, also of empty ones."""
    counts = memberships.groupBy("collection_id").agg(F.count("*").alias("n"))
    joined = collections.join(counts, collections["id"] == counts["collection_id"], "left")
    return joined.select("id", "name", F.coalesce("n", F.lit(0)).alias("document_count"))


def by_name(rows: DataFrame, name: str, place: str) -> DataFrame:
    """Add the place of each row by name, case of ASCII letters ignored, then by id; for short lists such as collections."""
    return rows.withColumn(place, F.row_number().over(Window.orderBy(ascii_lower(F.col(name)), "id")))


def vault_stats(documents: DataFrame, chunks: DataFrame, size: Column) -> DataFrame:
    """document_count, chunk_count, embedding_dims (0 without a vector), db_size_human as one row."""
    n = documents.agg(F.count("*").alias("document_count"), F.sum(size).alias("bytes"))
    m = chunks.agg(F.count("*").alias("chunk_count"), F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("embedding_dims"))
    # Two frames of one row each.
    return n.join(F.broadcast(m), F.lit(True)).select("document_count", "chunk_count", "embedding_dims", humanize_bytes(F.coalesce("bytes", F.lit(0))).alias("db_size_human"))


def collection_source_paths(documents: DataFrame, members: DataFrame) -> DataFrame:
    """The distinct source paths of a collection's documents."""
    return documents.join(members.select("document_id"), "document_id", "left_semi").select("source_path").distinct()


def existing_ids(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """pos, document_id of the wanted ids that exist, with their place in the list."""
    return wanted.join(documents.select("document_id"), "document_id", "left_semi").select("pos", "document_id")
