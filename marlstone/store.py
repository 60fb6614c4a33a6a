"""The store: Parquet tables in snapshots, changed together by moving one pointer."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.chunking import chunk_record
from marlstone.functions.text import ascii_lower, contains_folded, record_hash
from marlstone.session import Scratch

SCHEMAS = {
    "documents": "document_id string, source_path string, file_type string, title string, raw_text string, ingested_at timestamp, sha256 string, ingest_seq long",
    "chunks": "chunk_id string, document_id string, chunk_index int, text string, token_count int, char_start int, char_end int, embedding array<float>",
    "tags": "document_id string, tag string",
    "collections": "id long, name string",
    "members": "document_id string, collection_id long",
}


def chunk_rows(parts: DataFrame, start: Column, end: Column, embedding: Callable[[Column], Column] | None = None) -> DataFrame:
    """Rows of the chunks table out of (document_id, chunk_index, text); without an embedding vectors are null."""
    vector = embedding(F.col("text")) if embedding else F.lit(None).cast("array<float>")
    return parts.select(
        F.concat_ws(":", "document_id", F.col("chunk_index").cast("string")).alias("chunk_id"), "document_id", "chunk_index", "text",
        (F.octet_length("text") / 4).cast("int").alias("token_count"), start.alias("char_start"), end.alias("char_end"), vector.alias("embedding"),
    )


class Store:
    """One writer at a time; readers keep the snapshot that they resolved."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._fs_path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._fs_path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _pointer(self) -> dict[str, list[str]]:
        """Folders of each table in the current snapshot: the newest complete pointer file."""
        folder = self._fs_path(f"{self.path}/snapshots")
        if not self._fs.exists(folder):
            return {}
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(folder) if s.getPath().getName().endswith(".json"))
        return json.loads(self.spark.read.text(f"{self.path}/snapshots/{names[-1]}", wholetext=True).first()[0]) if names else {}

    def read(self, table: str) -> DataFrame:
        at = self._pointer().get(table)
        schema = SCHEMAS[table]
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{folder}" for folder in at]) if at else self.spark.createDataFrame([], schema)

    def commit(self, append: dict[str, DataFrame] | None = None, **tables: DataFrame) -> None:
        """Write rows to append beside a table's folders and changed tables anew, then name them all at once."""
        pointer = self._pointer()
        for name, df in [*(append or {}).items(), *tables.items()]:
            folder = f"{name}/{uuid.uuid4().hex}"
            columns = [c.split()[0] for c in SCHEMAS[name].split(", ")]
            df.select(*columns).write.parquet(f"{self.path}/{folder}")
            pointer[name] = [folder] if name in tables else [*pointer.get(name, []), folder]
        folder = f"{self.path}/snapshots"
        number = len(self._fs.listStatus(self._fs_path(folder))) if self._fs.exists(self._fs_path(folder)) else 0
        draft, final = self._fs_path(f"{self.path}/draft-{uuid.uuid4().hex}"), self._fs_path(f"{folder}/{number:012d}.json")
        out = self._fs.create(draft)
        out.write(bytearray(json.dumps(pointer).encode()))
        out.close()
        self._fs.mkdirs(self._fs_path(folder))
        if not self._fs.rename(draft, final):
            raise RuntimeError(f"another writer made snapshot {number}")

    def ingest(self, documents: DataFrame, chunks: DataFrame, collection: int | None = None) -> int:
        """Add documents whose content (sha256) is new, and their chunks; the number added.

        Of equal contents within the batch the first in ingest_seq is kept. Contents that
        the store has only join the collection. Chunks of documents left out are left out.
        Only the new rows are written.
        """
        old = self.read("documents")
        firsts = documents.groupBy("sha256").agg(F.min_by("document_id", F.struct("ingest_seq", "document_id")).alias("document_id"))
        new = documents.dropDuplicates(["document_id"]).join(firsts, ["sha256", "document_id"], "left_semi").join(old.select("sha256"), "sha256", "left_anti")
        with Scratch(self.spark, "ingest") as scratch:
            new = scratch.cut(new)
            added = new.count()
            rows = {"documents": new, "chunks": chunks.join(new.select("document_id"), "document_id", "left_semi")} if added else {}
            if collection is not None:
                ids = old.select("document_id", "sha256").unionByName(new.select("document_id", "sha256")).join(documents.select("sha256").distinct(), "sha256", "left_semi")
                ids = ids.select("document_id", F.lit(collection).cast("long").alias("collection_id"))
                rows["members"] = ids.join(self.read("members"), ["document_id", "collection_id"], "left_anti")
            if rows:
                self.commit(append=rows)
        return added

    def ingest_records(self, records: DataFrame, kind: str, embedding: Callable[[Column], Column] | None = None, collection: int | None = None, after: int = 0) -> int:
        """Add archive records (source_path, record_id, title, body), chunked and embedded; the number added.

        A record is known by the hash of its id and body. Null ids and bodies count as empty.
        """
        rows = records.select("source_path", F.coalesce("record_id", F.lit("")).alias("record_id"), "title", F.coalesce("body", F.lit("")).alias("body"))
        hashed = rows.withColumn("sha256", record_hash(F.col("record_id"), F.col("body")))
        ids = F.sha2(F.concat_ws("\u0000", "source_path", "sha256"), 256)
        documents = hashed.select(
            ids.alias("document_id"), "source_path", F.lit(kind).alias("file_type"), "title", F.col("body").alias("raw_text"), F.current_timestamp().alias("ingested_at"), "sha256",
            (F.lit(after) + F.monotonically_increasing_id()).alias("ingest_seq"),
        )
        parts = documents.select("document_id", F.posexplode(chunk_record(F.col("raw_text"))).alias("chunk_index", "text"))
        return self.ingest(documents, chunk_rows(parts, F.lit(0), F.octet_length("text"), embedding), collection)

    def upsert(self, table: str, rows: DataFrame, key: str) -> None:
        """Put rows in the place of those of equal key, else beside them; of rows of one key any stands."""
        rows = rows.dropDuplicates([key])
        have = self.read(table)
        if have.join(rows.select(key), key, "left_semi").isEmpty():
            self.commit(append={table: rows})
        else:
            self.commit(**{table: have.join(rows.select(key), key, "left_anti").unionByName(rows.select(have.columns))})

    def clear(self, dry_run: bool = False) -> tuple[int, int]:
        """Delete all documents with their chunks, tags and memberships; collections stay."""
        return self.delete(F.lit(True), dry_run)

    def collection_named(self, name: str) -> int:
        """The id of the collection of this name, case of ASCII letters ignored, made if there is none."""
        have = self.read("collections").where(ascii_lower(F.col("name")) == ascii_lower(F.lit(name.strip()))).orderBy("id").first()
        return have["id"] if have else self.create_collection(name)

    def members_of_paths(self, number: int, paths: DataFrame, remove: bool = False) -> int:
        """Add all documents of some source paths to a collection, or remove them; the memberships changed."""
        ids = self.read("documents").join(paths.select("source_path"), "source_path", "left_semi").select("document_id")
        return self.remove_members(number, ids) if remove else self.add_members(number, ids)

    def add_tags(self, tags: DataFrame) -> None:
        new = tags.where("trim(tag) != '' AND document_id IS NOT NULL").select("document_id", "tag").distinct()
        self.commit(append={"tags": new.join(self.read("tags"), ["document_id", "tag"], "left_anti")})

    def create_collection(self, name: str) -> int:
        """The id of a new collection; an empty name or one that exists raises."""
        name, have = name.strip(), self.read("collections")
        if not name or not have.where(F.col("name") == name).isEmpty():
            raise ValueError(f"no such new collection name: {name!r}")
        number = (have.agg(F.max("id")).first()[0] or 0) + 1
        self.commit(append={"collections": self.spark.createDataFrame([(number, name)], SCHEMAS["collections"])})
        return number

    def delete_collection(self, number: int) -> bool:
        """Drop a collection and its memberships; its documents stay."""
        have = self.read("collections")
        if have.where(F.col("id") == number).isEmpty():
            return False
        self.commit(collections=have.where(F.col("id") != number), members=self.read("members").where(F.col("collection_id") != number))
        return True

    def add_members(self, number: int, ids: DataFrame) -> int:
        """Memberships actually added; unknown document ids raise."""
        ids = ids.select("document_id").distinct()
        if not ids.join(self.read("documents"), "document_id", "left_anti").isEmpty():
            raise ValueError("unknown document ids")
        have = self.read("members")
        new = ids.withColumn("collection_id", F.lit(number).cast("long")).join(have, ["document_id", "collection_id"], "left_anti")
        added = new.count()
        if added:
            self.commit(append={"members": new})
        return added

    def remove_members(self, number: int, ids: DataFrame) -> int:
        """Memberships removed."""
        have = self.read("members")
        gone = have.where(F.col("collection_id") == number).join(ids.select("document_id"), "document_id", "left_semi")
        removed = gone.count()
        if removed:
            self.commit(members=have.join(gone, ["document_id", "collection_id"], "left_anti"))
        return removed

    def delete(self, which: Column, dry_run: bool = False) -> tuple[int, int]:
        """(documents, chunks) that the predicate on documents deletes; with dry_run nothing is written."""
        documents, chunks = self.read("documents"), self.read("chunks")
        gone = documents.where(F.coalesce(which, F.lit(False))).select("document_id")
        counts = gone.count(), chunks.join(gone, "document_id", "left_semi").count()
        if not dry_run and counts[0]:
            keep = lambda df: df.join(gone, "document_id", "left_anti")
            self.commit(documents=keep(documents), chunks=keep(chunks), tags=keep(self.read("tags")), members=keep(self.read("members")))
        return counts


def by_path(path: str) -> Column:
    """Documents of exactly this path or id."""
    return (F.col("source_path") == path) | (F.col("document_id") == path)


def by_prefix(prefix: str) -> Column:
    """Documents below a literal prefix, case of ASCII letters ignored."""
    return contains_folded(F.substring("source_path", 1, len(prefix)), prefix)


def by_file_type(kind: str) -> Column:
    return F.col("file_type") == kind
