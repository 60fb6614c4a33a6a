"""Hybrid retrieval: exact cosine ranks and BM25 ranks, fused by reciprocal ranks."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.text import fold_words, query_terms
from marlstone.functions.vectors import cosine
from marlstone.operators.catalog import clamp
from marlstone.operators.fulltext import TextIndex, indexed
from marlstone.operators.ranking import split_rank

RRF_K, SPARSE_POOL = 60, 200
MOST_HITS, WIDEST_CONTEXT = 100, 20  # bounds of a page and of a context


@dataclass(frozen=True)
class SearchOptions:
    """Filters applied after fusion; all that are set must hold."""

    source: str | None = None  # part of the source, case counts
    tags: list[str] = field(default_factory=list)  # any of these
    file_type: str | None = None
    collection: DataFrame | None = None  # document_id of its members; an empty one finds nothing


def dense_ranks(chunks: DataFrame, vector: list[float]) -> DataFrame:
    """chunk_id, cos, rank: every chunk with a vector by falling cosine, from 0.

    Equal similarities (to nine digits) are ordered by chunk_id. Ranks come from counts per
    slice of similarity, so that no task sorts the whole corpus.
    """
    query = F.array(*[F.lit(float(x)) for x in vector])
    scored = chunks.where(F.col("embedding").isNotNull()).select("chunk_id", F.round(cosine(F.col("embedding"), query), 9).alias("cos"))
    return split_rank(scored, [], [F.col("cos").desc(), F.col("chunk_id")], -F.floor(F.col("cos") * 5000), "rank")


def parse_query(spark, text: str) -> list[list[str]]:
    """The terms of a query, each as its index words; terms without words are dropped."""
    row = spark.range(1).select(F.transform(query_terms(F.lit(text)), fold_words).alias("t")).first()
    return [list(t) for t in row["t"] if t]


def sparse_ranks(index: TextIndex, terms: list[list[str]], pool: int = SPARSE_POOL) -> DataFrame:
    """chunk_id, rank of the best chunks by BM25; the pool is part of the definition of this leg."""
    best = index.bm25(terms).withColumn("bm25", F.round("bm25", 9)).orderBy("bm25", "chunk_id").limit(pool)
    # A window over the pool's rows only, which one task may hold.
    return best.select("chunk_id", (F.row_number().over(Window.orderBy("bm25", "chunk_id")) - 1).cast("long").alias("rank"))


def fused(chunks: DataFrame, vector: list[float] | None, text: str, index: TextIndex | None = None) -> DataFrame:
    """chunk_id, score: sum over the legs of 1 / (60 + rank + 1).

    index: the stored index of these chunks; without one they are indexed first.
    """
    spark = chunks.sparkSession
    legs = []
    if vector is not None:
        legs.append(dense_ranks(chunks, vector).select("chunk_id", "rank"))
    if terms := parse_query(spark, text):
        legs.append(sparse_ranks(index or indexed(chunks), terms).select("chunk_id", "rank"))
    if not legs:
        return spark.createDataFrame([], "chunk_id string, score double")
    both = legs[0] if len(legs) == 1 else legs[0].unionByName(legs[1])
    return both.groupBy("chunk_id").agg(F.sum(F.lit(1.0) / (F.col("rank") + RRF_K + 1)).alias("score"))


def search(chunks: DataFrame, documents: DataFrame, tags: DataFrame, vector: list[float] | None, text: str, options: SearchOptions | None = None, index: TextIndex | None = None) -> DataFrame:
    """Every hit of a hybrid search: chunk_id, document_id, source, file_type, chunk_index, tags, score.

    chunks: chunk_id, document_id, chunk_index, text, embedding; documents: document_id,
    source_path, file_type; tags: document_id, tag. Filters follow the fusion, so ranks
    are those of the whole store. page() orders and cuts the result.
    """
    options = options or SearchOptions()
    hits = fused(chunks, vector, text, index).join(chunks.select("chunk_id", "document_id", "chunk_index"), "chunk_id")
    if options.collection is not None:
        hits = hits.join(options.collection.select("document_id"), "document_id", "left_semi")
    docs = documents.select("document_id", F.col("source_path").alias("source"), "file_type")
    if options.source:
        docs = docs.where(F.col("source").contains(options.source))
    if options.file_type:
        docs = docs.where(F.col("file_type") == options.file_type)
    of = tags.groupBy("document_id").agg(F.sort_array(F.collect_set("tag")).alias("tags"))
    out = hits.join(docs, "document_id").join(of, "document_id", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))
    if options.tags:
        out = out.where(F.arrays_overlap("tags", F.array(*map(F.lit, options.tags))))
    return out.select("chunk_id", "document_id", "source", "file_type", "chunk_index", "tags", F.round("score", 9).alias("score"))


def page(hits: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """One page by falling score, equal ones by chunk_id; of MOST_HITS hits at most."""
    return hits.orderBy(F.col("score").desc(), "chunk_id").offset(max(0, offset)).limit(clamp(limit, 0, MOST_HITS))


def chunk_context(chunks: DataFrame, centres: DataFrame, before: int = 2, after: int = 2) -> DataFrame:
    """The chunks around each centre (chunk_id) within its document, by chunk_index.

    Widths are clamped to 0 and WIDEST_CONTEXT; unknown centres give nothing; no chunk of another document
    is reached. Result: centre, chunk_id, document_id, chunk_index, text.
    """
    mid = centres.select("chunk_id").distinct().join(chunks, "chunk_id").select(F.col("chunk_id").alias("centre"), "document_id", F.col("chunk_index").alias("_at"))
    near = F.col("chunk_index").between(F.col("_at") - clamp(before, 0, WIDEST_CONTEXT), F.col("_at") + clamp(after, 0, WIDEST_CONTEXT))
    return mid.join(chunks, "document_id").where(near).select("centre", "chunk_id", "document_id", "chunk_index", "text")
