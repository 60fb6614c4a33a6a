"""Retrieval queries over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.text import fold_words, query_terms
from marlstone.functions.vectors import cosine, l2_normalised
from marlstone.operators import search as s
from marlstone.operators.fulltext import TextIndex, indexed
from marlstone.plans import views
from marlstone.plans.views import SQL_TURNS, SQL_VIEWS
from marlstone.tables import table

QUERY = "quarterly ledger error-rate ledger zephyr"
TERMS = [["quarterly"], ["ledger"], ["error", "rate"], ["ledger"], ["zephyr"]]


def _vector(spark: SparkSession, base: str) -> list[float]:
    """The query vector: the first of the embeddings."""
    return [float(x) for x in table(spark, base, "embeddings").orderBy("vec_id").first()["embedding"]]


_indexes: dict[tuple[str, str], TextIndex] = {}


def _index(spark: SparkSession, base: str) -> TextIndex:
    """The stored index of a folder's documents: made when the session first needs it."""
    key = (spark.sparkContext.applicationId, base)
    if key not in _indexes:
        _indexes[key] = indexed(views.chunks(spark, base))
    return _indexes[key]


def _hits(spark: SparkSession, base: str, options: s.SearchOptions | None = None, vector: bool = True) -> DataFrame:
    v = _vector(spark, base) if vector else None
    return s.search(views.chunks(spark, base), views.documents(spark, base), views.tags(spark, base), v, QUERY, options, _index(spark, base))


def _shown(hits: DataFrame) -> DataFrame:
    return hits.select("chunk_id", "document_id", "source", "file_type", "chunk_index", F.array_join("tags", ",").alias("tags"), "score")


def hybrid_search(spark, base):
    return _shown(s.page(_hits(spark, base), 20))


def hybrid_search_page2(spark, base):
    return _shown(s.page(_hits(spark, base), 20, 20))


def hybrid_total(spark, base):
    return _hits(spark, base).agg(F.count("*").alias("total"))


def dense_topk(spark, base):
    return s.dense_ranks(views.chunks(spark, base), _vector(spark, base)).orderBy("rank").limit(20)


def dense_rank_full(spark, base):
    return s.dense_ranks(views.chunks(spark, base), _vector(spark, base))


def bm25_all(spark, base):
    return _index(spark, base).bm25(TERMS).select("chunk_id", F.round("bm25", 6).alias("bm25"))


def bm25_topk(spark, base):
    return s.sparse_ranks(_index(spark, base), s.parse_query(spark, QUERY)).select("chunk_id", "rank")


def fts_query_terms(spark, base):
    """Search terms of every evaluation item."""
    return table(spark, base, "eval_items").select("item_id", F.array_join(query_terms(F.col("text")), " ").alias("terms"))


def term_stats(spark, base):
    """Documents and occurrences of every index term."""
    words = table(spark, base, "documents").select("doc_id", F.explode(fold_words(F.col("text"))).alias("term"))
    counted = words.groupBy("term", "doc_id").agg(F.count("*").alias("tf"))
    return counted.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def postings(spark, base):
    """term, doc_id, tf and first place of every index term."""
    words = table(spark, base, "documents").select("doc_id", F.posexplode(fold_words(F.col("text"))).alias("pos", "term"))
    return words.groupBy("term", "doc_id").agg(F.count("*").alias("tf"), F.min("pos").alias("first_pos"))


def search_filter_source(spark, base):
    return _shown(s.page(_hits(spark, base, s.SearchOptions(source="/wiki/")), 50))


def search_filter_tags(spark, base):
    return _shown(s.page(_hits(spark, base, s.SearchOptions(tags=["abusive", "sexual"])), 50))


def search_filter_file_type(spark, base):
    return _shown(s.page(_hits(spark, base, s.SearchOptions(file_type="mbox")), 50))


def _collection(spark, base, number: int) -> DataFrame:
    return views.memberships(spark, base).where(F.col("collection_id") == number)


def search_filter_collection(spark, base):
    return _shown(s.page(_hits(spark, base, s.SearchOptions(collection=_collection(spark, base, 2))), 50))


def search_empty_collection(spark, base):
    return _shown(s.page(_hits(spark, base, s.SearchOptions(collection=_collection(spark, base, 4))), 50))


def search_keyword_only(spark, base):
    return _shown(s.page(_hits(spark, base, vector=False), 50))


def chunk_context(spark, base):
    """The turn before and after each first place of a conversation, for all conversations."""
    t = views.turns(spark, base)
    return s.chunk_context(t, t.where("chunk_index = 1").select("chunk_id"), 1, 1).drop("text")


def chunk_context_bulk(spark, base):
    """Each turn with the words of its neighbourhood of two on both sides."""
    t = views.turns(spark, base)
    size = t.select("chunk_id", "document_id", "chunk_index", F.coalesce(F.length("text"), F.lit(0)).alias("n"))
    near = size.select("document_id", F.explode(F.sequence(F.col("chunk_index") - 2, F.col("chunk_index") + 2)).alias("chunk_index"), "n")
    around = near.groupBy("document_id", "chunk_index").agg(F.count("*").alias("n_around"), F.sum("n").alias("chars_around"))
    return size.join(around, ["document_id", "chunk_index"]).select("chunk_id", "n_around", "chars_around")


def mean_pool_l2(spark, base):
    """The mean vector of each label's embeddings at length 1, one row per component."""
    parts = table(spark, base, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x"))
    mean = parts.groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    vector = mean.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "m"))), lambda p: p["m"]).alias("v"))
    return vector.select("label", F.posexplode(l2_normalised(F.col("v"))).alias("pos", "x")).select("label", "pos", F.round("x", 6).alias("x"))


def label_centroid_similarity(spark, base):
    """Cosine of each embedding to the mean of its label."""
    e = table(spark, base, "embeddings")
    parts = e.select("label", F.posexplode("embedding").alias("pos", "x")).groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    mean = parts.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "m"))), lambda p: p["m"]).alias("v"))
    return e.join(mean, "label").select("vec_id", "label", F.round(cosine(F.col("embedding"), F.col("v")), 6).alias("cos"))


# Letters lose their accents if they are Latin; the final sigma is a sigma.
_FOLDED = "array_to_string(list_transform(string_split(replace(lower(coalesce(text, '')), 'ς', 'σ'), ''), lambda c: CASE WHEN regexp_matches(c, '\\p{Latin}') THEN strip_accents(c) ELSE c END), '')"
_WORDS = f"regexp_extract_all({_FOLDED}, '[\\p{{L}}\\p{{N}}]+')"


def _tf(term: list[str]) -> str:
    if len(term) == 1:
        return f"len(list_filter(w, lambda x: x = '{term[0]}'))"
    same = " AND ".join(f"w[i + {k}] = '{t}'" for k, t in enumerate(term))
    return f"len(list_filter(range(1, greatest(len(w) - {len(term) - 2}, 1)), lambda i: {same}))"


_BM25 = (
    f"words AS (SELECT chunk_id, {_WORDS} AS w FROM chunks), "
    f"tf AS (SELECT chunk_id, len(w) AS n_words, {', '.join(f'{_tf(t)} AS tf{i}' for i, t in enumerate(TERMS))} FROM words), "
    f"tot AS (SELECT count(*) AS n, avg(n_words) AS mean, {', '.join(f'count(*) FILTER (tf{i} > 0) AS df{i}' for i in range(len(TERMS)))} FROM tf), "
    "bm AS (SELECT chunk_id, -("
    + " + ".join(
        f"greatest(CASE WHEN ln((n - df{i} + 0.5) / (df{i} + 0.5)) > 0 THEN ln((n - df{i} + 0.5) / (df{i} + 0.5)) ELSE 1e-6 END, 1e-6) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * n_words / mean))"
        for i in range(len(TERMS))
    )
    + f") AS bm25 FROM tf, tot WHERE greatest({', '.join(f'tf{i}' for i in range(len(TERMS)))}) > 0)"
)
_SPARSE = "sparse AS (SELECT chunk_id, row_number() OVER (ORDER BY round(bm25, 9), chunk_id) - 1 AS rank FROM bm ORDER BY round(bm25, 9), chunk_id LIMIT 200)"
_DENSE = (
    "q AS (SELECT embedding AS v FROM embeddings ORDER BY vec_id LIMIT 1), "
    "cosines AS (SELECT chunk_id, round(list_cosine_similarity(embedding::DOUBLE[], v::DOUBLE[]), 9) AS cos FROM chunks, q WHERE embedding IS NOT NULL), "
    "dense AS (SELECT chunk_id, cos, row_number() OVER (ORDER BY cos DESC, chunk_id) - 1 AS rank FROM cosines)"
)


def _search_sql(where: str = "true", limit: int = 50, offset: int = 0, dense: bool = True) -> str:
    legs = "SELECT chunk_id, rank FROM sparse" + (" UNION ALL SELECT chunk_id, rank FROM dense" if dense else "")
    return (
        f"WITH {SQL_VIEWS}, {_BM25}, {_SPARSE}, {_DENSE}, legs AS ({legs}), "
        "fused AS (SELECT chunk_id, sum(1.0::DOUBLE / (rank + 61)) AS score FROM legs GROUP BY chunk_id), "
        "tagged AS (SELECT document_id, string_agg(tag, ',' ORDER BY tag) AS tags, list(tag) AS taglist FROM tags GROUP BY document_id) "
        "SELECT f.chunk_id, c.document_id, d.source_path AS source, d.file_type, c.chunk_index, coalesce(t.tags, '') AS tags, round(f.score, 9) AS score "
        "FROM fused f JOIN chunks c USING (chunk_id) JOIN docs d ON d.document_id = c.document_id LEFT JOIN tagged t ON t.document_id = c.document_id "
        f"WHERE {where} ORDER BY round(f.score, 9) DESC, f.chunk_id LIMIT {limit} OFFSET {offset}"
    )


_POOL = "parts AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings), mean AS (SELECT label, pos, avg(x) AS m FROM parts GROUP BY label, pos)"
ORACLES = {
    "hybrid_search": _search_sql(limit=20),
    "hybrid_search_page2": _search_sql(limit=20, offset=20),
    "hybrid_total": f"SELECT count(*) AS total FROM ({_search_sql(limit=1_000_000_000)})",
    "dense_topk": f"WITH {SQL_VIEWS}, {_DENSE} SELECT chunk_id, cos, rank FROM dense ORDER BY rank LIMIT 20",
    "dense_rank_full": f"WITH {SQL_VIEWS}, {_DENSE} SELECT chunk_id, cos, rank FROM dense",
    "bm25_all": f"WITH {SQL_VIEWS}, {_BM25} SELECT chunk_id, round(bm25, 6) AS bm25 FROM bm",
    "bm25_topk": f"WITH {SQL_VIEWS}, {_BM25}, {_SPARSE} SELECT chunk_id, rank FROM sparse",
    "fts_query_terms": "SELECT item_id, array_to_string(list_filter(regexp_extract_all(coalesce(text, ''), '[\\p{L}\\p{N}_.-]+'), lambda t: length(t) >= 2), ' ') AS terms FROM eval_items",
    "term_stats": f"WITH t AS (SELECT doc_id, unnest({_WORDS}) AS term FROM documents), c AS (SELECT term, doc_id, count(*) AS tf FROM t GROUP BY ALL) SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM c GROUP BY term",
    "postings": f"WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents), t AS (SELECT doc_id, unnest(w) AS term, generate_subscripts(w, 1) - 1 AS pos FROM w) SELECT term, doc_id, count(*) AS tf, min(pos)::INT AS first_pos FROM t GROUP BY term, doc_id",
    "search_filter_source": _search_sql("contains(d.source_path, '/wiki/')"),
    "search_filter_tags": _search_sql("list_has_any(t.taglist, ['abusive', 'sexual'])"),
    "search_filter_file_type": _search_sql("d.file_type = 'mbox'"),
    "search_filter_collection": _search_sql("c.document_id IN (SELECT document_id FROM members WHERE collection_id = 2)"),
    "search_empty_collection": _search_sql("c.document_id IN (SELECT document_id FROM members WHERE collection_id = 4)"),
    "search_keyword_only": _search_sql(dense=False),
    "chunk_context": f"WITH t AS ({SQL_TURNS}) SELECT a.chunk_id AS centre, b.chunk_id, b.document_id, b.chunk_index FROM t a JOIN t b ON a.document_id = b.document_id AND b.chunk_index BETWEEN a.chunk_index - 1 AND a.chunk_index + 1 WHERE a.chunk_index = 1",
    "chunk_context_bulk": f"WITH t AS ({SQL_TURNS}) SELECT chunk_id, count(*) OVER w AS n_around, (sum(coalesce(length(text), 0)) OVER w)::BIGINT AS chars_around FROM t WINDOW w AS (PARTITION BY document_id ORDER BY chunk_index RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING)",
    "mean_pool_l2": f"WITH {_POOL}, n AS (SELECT label, sqrt(sum(m * m)) AS norm FROM mean GROUP BY label) SELECT label, pos::INT AS pos, round(CASE WHEN norm > 0 THEN m / norm ELSE m END, 6) AS x FROM mean JOIN n USING (label)",
    "label_centroid_similarity": f"WITH {_POOL}, v AS (SELECT label, list(m ORDER BY pos) AS v FROM mean GROUP BY label) SELECT vec_id, e.label, round(list_cosine_similarity(embedding::DOUBLE[], v), 6) AS cos FROM embeddings e JOIN v USING (label)",
}
QUERIES = {name: globals()[name] for name in ORACLES}
