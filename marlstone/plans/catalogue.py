"""Catalogue, membership, deduplication and deletion queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions.text import record_hash
from marlstone.operators import catalog as c
from marlstone.plans import views
from marlstone.plans.views import SQL_VIEWS
from marlstone.tables import table

PATH, PREFIX = "/docs/wiki/search", "/docs/MAIL/"


def _sources(spark, base, **kw):
    return c.list_sources(views.documents(spark, base), views.chunks(spark, base), **kw)


def list_sources_by_name(spark, base):
    return c.ordered_page(_sources(spark, base), None, ["path"], 50)


def list_sources_by_date(spark, base):
    return c.ordered_page(_sources(spark, base), "ingested_at", ["path"], 50)


def list_sources_by_chunks(spark, base):
    return c.ordered_page(_sources(spark, base), "chunk_count", ["path"], 50)


def list_sources_by_records(spark, base):
    return c.ordered_page(_sources(spark, base), "record_count", ["path"], 50)


def list_sources_filtered(spark, base):
    members = views.memberships(spark, base).where("collection_id = 1")
    return c.ordered_page(_sources(spark, base, q="WIKI/s", file_type="md", collection=members), None, ["path"], 50)


def sources_total(spark, base):
    return views.documents(spark, base).agg(F.count_distinct("source_path").alias("total"))


def _documents(spark, base, **kw):
    rows = c.list_documents(views.documents(spark, base), views.chunks(spark, base), views.memberships(spark, base), **kw)
    return rows.withColumn("collection_ids", F.array_join(F.transform("collection_ids", lambda x: x.cast("string")), ","))


def list_documents(spark, base):
    return c.ordered_page(_documents(spark, base), "ingested_at", ["source_path", "document_id"], 1000)


def list_documents_q(spark, base):
    return c.ordered_page(_documents(spark, base, q="LEDGER"), None, ["source_path", "document_id"], 1000)


def records_by_source_page(spark, base):
    rows = c.records_by_source(views.documents(spark, base), PATH)
    return rows.orderBy("ingest_seq").offset(3).limit(10).select("document_id", "title", "text", "ingested_at")


def records_by_source_total(spark, base):
    return c.records_by_source(views.documents(spark, base), PATH).agg(F.count("*").alias("total"))


def get_document(spark, base):
    return c.get_document(views.documents(spark, base), PATH).select("document_id", "source_path", "title", "raw_text")


def list_file_types(spark, base):
    return c.list_file_types(views.documents(spark, base))


def list_tags(spark, base):
    return c.list_tags(views.tags(spark, base))


def list_collections(spark, base):
    """Collections by name, case ignored; the place is part of the row."""
    rows = c.list_collections(views.collections(spark), views.memberships(spark, base))
    return c.by_name(rows, "name", "place")


def vault_stats(spark, base):
    size = F.coalesce(F.octet_length("raw_text"), F.lit(0)).cast("long")
    return c.vault_stats(views.documents(spark, base), views.chunks(spark, base), size)


def collection_source_paths(spark, base):
    return c.collection_source_paths(views.documents(spark, base), views.memberships(spark, base).where("collection_id = 3"))


def filter_existing_ids(spark, base):
    """Ids of vectors, in their order, that are ids of documents too."""
    wanted = table(spark, base, "embeddings").select(F.col("vec_id").alias("pos"), F.col("vec_id").alias("document_id"))
    return c.existing_ids(views.documents(spark, base), wanted)


def _hashed(spark, base):
    """Every row with the hash of its record; null ids and bodies count as empty, a null batch as the history."""
    r = table(spark, base, "records")
    text = lambda c: F.coalesce(c, F.lit(""))
    return r.select("rec_key", F.coalesce("batch_id", F.lit(0)).alias("batch_id"), record_hash(text("record_id"), text("body")).alias("sha256"))


def record_hashes(spark, base):
    return _hashed(spark, base)


def dedup_by_hash(spark, base):
    """Rows of later batches whose content is new: not in the history, first of their hash."""
    h = _hashed(spark, base)
    new = h.where("batch_id > 0").join(h.where("batch_id = 0").select("sha256"), "sha256", "left_anti")
    return new.groupBy("sha256").agg(F.min("rec_key").alias("rec_key"))


def dedup_join_collection(spark, base):
    """Rows of later batches that hit the history: the stored row that joins the collection instead."""
    h = _hashed(spark, base)
    stored = h.where("batch_id = 0").groupBy("sha256").agg(F.min("rec_key").alias("stored_key"))
    return h.where("batch_id > 0").join(stored, "sha256").select("rec_key", "stored_key")


def _preview(spark, base, keep):
    d = views.documents(spark, base).where(keep)
    n = views.chunks(spark, base).join(d.select("document_id"), "document_id", "left_semi").agg(F.count("*").alias("n_chunks"))
    return d.agg(F.count("*").alias("n_documents")).join(F.broadcast(n), F.lit(True))


def _prefixed(column="source_path"):
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(column, upper, lower).startswith(PREFIX.lower())


def delete_preview_exact(spark, base):
    return _preview(spark, base, (F.col("source_path") == PATH) | (F.col("document_id").cast("string") == PATH))


def delete_preview_prefix(spark, base):
    return _preview(spark, base, _prefixed())


def delete_preview_type(spark, base):
    return _preview(spark, base, F.col("file_type") == "csv")


def delete_survivors(spark, base):
    return views.documents(spark, base).where(~_prefixed()).select("document_id", "source_path")


def collection_add_new_pairs(spark, base):
    """Pairs that adding all markdown documents to collection 1 would insert."""
    m = views.memberships(spark, base).where("collection_id = 1")
    d = views.documents(spark, base).where("file_type = 'md'").select("document_id", F.lit(1).cast("bigint").alias("collection_id"))
    return d.join(m, ["document_id", "collection_id"], "left_anti")


def collection_remove(spark, base):
    """Members left after removing the markdown documents from collection 1."""
    m = views.memberships(spark, base).where("collection_id = 1")
    return m.join(views.documents(spark, base).where("file_type = 'md'").select("document_id"), "document_id", "left_anti")


_SRC = "SELECT source_path AS path, min(file_type) AS file_type, count(DISTINCT d.document_id) AS record_count, count(c.chunk_id) AS chunk_count, max(ingested_at) AS ingested_at FROM docs d LEFT JOIN chunks c ON c.document_id = d.document_id"
_DOC = """SELECT d.document_id, source_path, title, file_type, (SELECT count(*) FROM chunks c WHERE c.document_id = d.document_id) AS chunk_count, ingested_at,
 coalesce((SELECT string_agg(m.collection_id::VARCHAR, ',' ORDER BY m.collection_id) FROM members m WHERE m.document_id = d.document_id), '') AS collection_ids FROM docs d"""
_HASH = "SELECT rec_key, coalesce(batch_id, 0) AS batch_id, sha256(encode(coalesce(record_id, '')) || '\\x00'::BLOB || encode(coalesce(body, ''))) AS sha256 FROM records"
_LOWER = "translate(source_path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _preview_sql(where: str) -> str:
    return f"WITH {SQL_VIEWS}, hit AS (SELECT document_id FROM docs WHERE {where}) SELECT (SELECT count(*) FROM hit) AS n_documents, (SELECT count(*) FROM chunks WHERE document_id IN (SELECT document_id FROM hit)) AS n_chunks"


ORACLES = {
    "list_sources_by_name": f"WITH {SQL_VIEWS} {_SRC} GROUP BY source_path ORDER BY path LIMIT 50",
    "list_sources_by_date": f"WITH {SQL_VIEWS} {_SRC} GROUP BY source_path ORDER BY ingested_at DESC, path LIMIT 50",
    "list_sources_by_chunks": f"WITH {SQL_VIEWS} {_SRC} GROUP BY source_path ORDER BY chunk_count DESC, path LIMIT 50",
    "list_sources_by_records": f"WITH {SQL_VIEWS} {_SRC} GROUP BY source_path ORDER BY record_count DESC, path LIMIT 50",
    "list_sources_filtered": f"WITH {SQL_VIEWS} {_SRC} WHERE source_path ILIKE '%wiki/s%' AND file_type = 'md' AND EXISTS (SELECT 1 FROM members m WHERE m.document_id = d.document_id AND m.collection_id = 1) GROUP BY source_path ORDER BY path LIMIT 50",
    "sources_total": f"WITH {SQL_VIEWS} SELECT count(DISTINCT source_path) AS total FROM docs",
    "list_documents": f"WITH {SQL_VIEWS} {_DOC} ORDER BY ingested_at DESC, source_path, d.document_id LIMIT 1000",
    "list_documents_q": f"WITH {SQL_VIEWS} {_DOC} WHERE source_path ILIKE '%ledger%' OR title ILIKE '%ledger%' ORDER BY source_path, d.document_id LIMIT 1000",
    "records_by_source_page": f"WITH {SQL_VIEWS} SELECT document_id, title, raw_text AS text, ingested_at FROM docs WHERE source_path = '{PATH}' ORDER BY ingest_seq LIMIT 10 OFFSET 3",
    "records_by_source_total": f"WITH {SQL_VIEWS} SELECT count(*) AS total FROM docs WHERE source_path = '{PATH}'",
    "get_document": f"WITH {SQL_VIEWS} SELECT document_id, source_path, title, raw_text FROM docs WHERE source_path = '{PATH}' ORDER BY ingest_seq LIMIT 1",
    "list_file_types": f"WITH {SQL_VIEWS} SELECT file_type, count(DISTINCT source_path) AS source_count FROM docs GROUP BY file_type",
    "list_tags": f"WITH {SQL_VIEWS} SELECT tag, count(DISTINCT document_id) AS document_count FROM tags GROUP BY tag",
    "list_collections": f"WITH {SQL_VIEWS} SELECT id, name, (SELECT count(*) FROM members m WHERE m.collection_id = c.id) AS document_count, row_number() OVER (ORDER BY name COLLATE NOCASE, id) AS place FROM collections c",
    "vault_stats": f"""WITH {SQL_VIEWS}, b AS (SELECT count(*) AS n, coalesce(sum(octet_length(encode(raw_text))), 0)::DOUBLE AS s FROM docs) SELECT n AS document_count, (SELECT count(*) FROM chunks) AS chunk_count, (SELECT max(len(embedding))::INT FROM embeddings) AS embedding_dims,
 CASE WHEN s >= 1024**4 THEN printf('%.1f TB', s / 1024**4) WHEN s >= 1024**3 THEN printf('%.1f GB', s / 1024**3) WHEN s >= 1024**2 THEN printf('%.1f MB', s / 1024**2) WHEN s >= 1024 THEN printf('%.1f KB', s / 1024) ELSE printf('%.1f B', s) END AS db_size_human FROM b""",
    "collection_source_paths": f"WITH {SQL_VIEWS} SELECT DISTINCT source_path FROM docs JOIN members USING (document_id) WHERE collection_id = 3",
    "filter_existing_ids": "SELECT vec_id AS pos, vec_id AS document_id FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents)",
    "record_hashes": _HASH,
    "dedup_by_hash": f"WITH h AS ({_HASH}) SELECT sha256, min(rec_key) AS rec_key FROM h WHERE batch_id > 0 AND sha256 NOT IN (SELECT sha256 FROM h WHERE batch_id = 0) GROUP BY sha256",
    "dedup_join_collection": f"WITH h AS ({_HASH}), s AS (SELECT sha256, min(rec_key) AS stored_key FROM h WHERE batch_id = 0 GROUP BY sha256) SELECT rec_key, stored_key FROM h JOIN s USING (sha256) WHERE batch_id > 0",
    "delete_preview_exact": _preview_sql(f"source_path = '{PATH}'"),
    "delete_preview_prefix": _preview_sql(f"starts_with({_LOWER}, '{PREFIX.lower()}')"),
    "delete_preview_type": _preview_sql("file_type = 'csv'"),
    "delete_survivors": f"WITH {SQL_VIEWS} SELECT document_id, source_path FROM docs WHERE NOT starts_with({_LOWER}, '{PREFIX.lower()}')",
    "collection_add_new_pairs": f"WITH {SQL_VIEWS} SELECT document_id, 1::BIGINT AS collection_id FROM docs WHERE file_type = 'md' AND document_id NOT IN (SELECT document_id FROM members WHERE collection_id = 1)",
    "collection_remove": f"WITH {SQL_VIEWS} SELECT document_id, collection_id FROM members WHERE collection_id = 1 AND document_id NOT IN (SELECT document_id FROM docs WHERE file_type = 'md')",
}
QUERIES = {name: globals()[name] for name in ORACLES}
