"""The driver's tables as the store's model: documents, chunks, tags, collections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.tables import table

#: Collections: id, name and the source prefix of their members; the last has none.
COLLECTIONS = [(1, "Wiki", "/docs/wiki/"), (2, "mail", "/docs/mail/"), (3, "Slack", "/exports/slack/"), (4, "Empty", None)]


def documents(spark: SparkSession, base: str) -> DataFrame:
    d = table(spark, base, "documents")
    return d.select(
        F.col("doc_id").alias("document_id"), F.col("source").alias("source_path"), "file_type", "title",
        F.col("text").alias("raw_text"), "ingested_at", F.col("doc_id").alias("ingest_seq"),
    )


def chunks(spark: SparkSession, base: str) -> DataFrame:
    """One chunk per document, with its vector where there is one."""
    d, e = table(spark, base, "documents"), table(spark, base, "embeddings")
    return d.join(e.select("vec_id", "embedding"), d["doc_id"] == e["vec_id"], "left").select(
        F.concat(F.col("doc_id").cast("string"), F.lit(":0")).alias("chunk_id"), F.col("doc_id").alias("document_id"),
        F.lit(0).alias("chunk_index"), "text", "embedding",
    )


def turns(spark: SparkSession, base: str) -> DataFrame:
    """Messages as the chunks of their conversation, the first row of each place."""
    m = table(spark, base, "chat_messages").where("idx IS NOT NULL AND conversation_uuid IS NOT NULL")
    first = m.groupBy("conversation_uuid", "idx").agg(F.min_by("text", "row_id").alias("text"))
    return first.select(
        F.concat_ws(":", "conversation_uuid", F.col("idx").cast("int").cast("string")).alias("chunk_id"),
        F.col("conversation_uuid").alias("document_id"), F.col("idx").cast("int").alias("chunk_index"), "text",
    )


def tags(spark: SparkSession, base: str) -> DataFrame:
    t = table(spark, base, "content_labels").where("toxic = 1")
    return t.select(F.col("doc_id").alias("document_id"), F.coalesce("category", F.lit("toxic")).alias("tag")).distinct()


def collections(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, n) for i, n, _ in COLLECTIONS], "id bigint, name string")


def memberships(spark: SparkSession, base: str) -> DataFrame:
    d = table(spark, base, "documents")
    of = None
    for i, _, prefix in COLLECTIONS:
        if prefix:
            hit = F.col("source").startswith(prefix)
            of = F.when(hit, i) if of is None else of.when(hit, i)
    return d.select(F.col("doc_id").alias("document_id"), of.cast("bigint").alias("collection_id")).where("collection_id IS NOT NULL")


# The same views in SQL.
SQL_DOCS = "SELECT doc_id AS document_id, source AS source_path, file_type, title, text AS raw_text, ingested_at, doc_id AS ingest_seq FROM documents"
SQL_CHUNKS = "SELECT d.doc_id::VARCHAR || ':0' AS chunk_id, d.doc_id AS document_id, 0 AS chunk_index, d.text, e.embedding FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id"
SQL_TURNS = """SELECT conversation_uuid || ':' || idx::INT::VARCHAR AS chunk_id, conversation_uuid AS document_id, idx::INT AS chunk_index, arg_min_null(text, row_id) AS text
 FROM chat_messages WHERE idx IS NOT NULL AND conversation_uuid IS NOT NULL GROUP BY conversation_uuid, idx"""
SQL_TAGS = "SELECT DISTINCT doc_id AS document_id, coalesce(category, 'toxic') AS tag FROM content_labels WHERE toxic = 1"
SQL_COLLECTIONS = "SELECT * FROM (VALUES " + ", ".join(f"({i}::BIGINT, '{n}')" for i, n, _ in COLLECTIONS) + ") t(id, name)"
SQL_MEMBERS = (
    "SELECT doc_id AS document_id, CASE " + " ".join(f"WHEN starts_with(source, '{p}') THEN {i}" for i, _, p in COLLECTIONS if p)
    + " END::BIGINT AS collection_id FROM documents WHERE " + " OR ".join(f"starts_with(source, '{p}')" for _, _, p in COLLECTIONS if p)
)
SQL_VIEWS = f"docs AS ({SQL_DOCS}), chunks AS ({SQL_CHUNKS}), tags AS ({SQL_TAGS}), collections AS ({SQL_COLLECTIONS}), members AS ({SQL_MEMBERS})"
