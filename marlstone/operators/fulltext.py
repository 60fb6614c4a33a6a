"""A stored inverted index of chunk texts, and BM25 scores that read only the postings of their terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.text import fold_words
from marlstone.session import file_system, scratch

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Postings are laid apart by a hash of their term into this many folders.
BUCKETS = 64
_POSTINGS = "chunk_id string, term string, positions array<int>, bucket int"
_LENGTHS = "chunk_id string, len int"


def _bucket(term) -> F.Column:
    return F.pmod(F.hash(term), F.lit(BUCKETS))


class TextIndex:
    """Postings (term, chunk, places), lengths of the chunks and their totals in a folder.

    add() indexes chunks that the index lacks and remove() takes chunks out, so that the
    index can be kept with a store. A chunk is its chunk_id and text; a null text counts
    as an empty one. Each call writes files of its own; chunks taken out are kept as a
    list that readers leave out.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._fs, self._at = file_system(spark, self.path)

    def _read(self, name: str, schema: str) -> DataFrame:
        path = f"{self.path}/{name}"
        return self.spark.read.schema(schema).parquet(path) if self._fs.exists(self._at(path)) else self.spark.createDataFrame([], schema)

    def lengths(self) -> DataFrame:
        """chunk_id, len of every indexed chunk."""
        return self._read("lengths", _LENGTHS).join(self._read("removed", "chunk_id string"), "chunk_id", "left_anti")

    def add(self, chunks: DataFrame) -> None:
        """Index the chunks that are not in the index yet."""
        new = chunks.where("chunk_id IS NOT NULL").select("chunk_id", "text").dropDuplicates(["chunk_id"])
        new = new.join(self._read("lengths", _LENGTHS).select("chunk_id"), "chunk_id", "left_anti")
        words = new.select("chunk_id", fold_words(F.col("text")).alias("words"))
        places = words.select("chunk_id", F.posexplode("words").alias("pos", "term")).groupBy("chunk_id", "term").agg(F.sort_array(F.collect_list("pos")).alias("positions"))
        spread = places.withColumn("bucket", _bucket("term")).repartition("bucket", F.pmod(F.xxhash64("term"), F.lit(4))).sortWithinPartitions("bucket", "term")
        spread.write.mode("append").partitionBy("bucket").parquet(f"{self.path}/postings")
        words.select("chunk_id", F.size("words").alias("len")).write.mode("append").parquet(f"{self.path}/lengths")

    def remove(self, chunks: DataFrame) -> None:
        """Take chunks (chunk_id) out for good; an id taken out is not indexed again."""
        chunks.select("chunk_id").distinct().write.mode("append").parquet(f"{self.path}/removed")

    def postings(self, words: list[str]) -> DataFrame:
        """chunk_id, term, positions of some words; only the folders of their buckets are read."""
        buckets = [r[0] for r in self.spark.createDataFrame([(w,) for w in words], "w string").select(_bucket("w")).distinct().collect()]
        rows = self._read("postings", _POSTINGS).where(F.col("bucket").isin(buckets) & F.col("term").isin(words))
        return rows.drop("bucket").join(self._read("removed", "chunk_id string"), "chunk_id", "left_anti")

    def bm25(self, terms: list[list[str]]) -> DataFrame:
        """chunk_id, bm25 of the chunks that hold a term; repeated terms count as often.

        A term of several words is a phrase of adjacent ones. Smaller is better.
        """
        if not terms:
            return self.spark.createDataFrame([], "chunk_id string, bm25 double")
        held = self.postings(sorted({w for t in terms for w in t})).groupBy("chunk_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("at"))

        def starts_at(word: str, k: int) -> F.Column:
            """The places of a word, less its own place k in the term."""
            return F.transform(F.coalesce(F.element_at("at", F.lit(word)), F.array().cast("array<int>")), lambda p: p - k)

        counts = []
        for i, term in enumerate(terms):
            starts = starts_at(term[0], 0)
            for k, word in enumerate(term[1:], 1):
                starts = F.array_intersect(starts, starts_at(word, k))
            counts.append(F.size(starts).alias(f"tf{i}"))
        tf = held.select("chunk_id", *counts)
        n_terms = range(len(terms))
        # Two frames of one row each.
        all_ = self.lengths().agg(F.count("*").alias("n"), F.avg("len").alias("mean"))
        totals = tf.agg(*[F.sum((F.col(f"tf{i}") > 0).cast("int")).alias(f"df{i}") for i in n_terms]).join(F.broadcast(all_), F.lit(True)).first()
        score = F.lit(0.0)
        for i in n_terms:
            df, n = totals[f"df{i}"] or 0, totals["n"]
            idf = F.log(F.lit((n - df + 0.5) / (df + 0.5)))
            idf = F.when(idf > 0, idf).otherwise(LEAST_IDF)
            f = F.col(f"tf{i}").cast("double")
            score = score + idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("len") / F.lit(float(totals["mean"] or 1))))
        hit = F.greatest(*[F.col(f"tf{i}") for i in n_terms], F.lit(0)) > 0
        return tf.where(hit).join(self.lengths(), "chunk_id").select("chunk_id", (-score).alias("bm25"))


def indexed(chunks: DataFrame) -> TextIndex:
    """A new index of chunks in the shared folder."""
    index = TextIndex(chunks.sparkSession, scratch(chunks.sparkSession, "text-index"))
    index.add(chunks)
    return index
