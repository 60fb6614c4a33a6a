import math

from pyspark.sql import functions as F

from marlstone.functions.text import approximate_tokens, collapse_whitespace, derive_title, humanize_bytes, query_terms, strip_html
from marlstone.functions.vectors import cosine, from_blob, to_blob
from marlstone.operators import search as s
from marlstone.operators.fulltext import TextIndex, indexed
from marlstone.operators.ranking import split_rank

CHUNKS = "chunk_id string, document_id long, chunk_index int, text string, embedding array<float>"
DOCS = "document_id long, source_path string, file_type string"


def store(spark, rows):
    chunks = spark.createDataFrame([(f"{i}:0", i, 0, t, v) for i, t, v in rows], CHUNKS)
    docs = spark.createDataFrame([(i, f"/d/{i}", "md") for i, _, _ in rows], DOCS)
    return chunks, docs, spark.createDataFrame([(1, "x"), (1, "y")], "document_id long, tag string")


def test_rare_keyword_beats_equal_vectors(spark):
    rows = [(i, "growing tomatoes", [1.0, 0.0, 0.0]) for i in range(30)] + [(99, "see quartzmeadow.studio", [0.0, 1.0, 0.0])]
    hits = s.page(s.search(*store(spark, rows), [1.0, 0.0, 0.0], "quartzmeadow"), 5).collect()
    assert hits[0]["chunk_id"] == "99:0" and len(hits) == 5


def test_pages_filters_and_empty_store(spark):
    chunks, docs, tags = store(spark, [(i, "shared keyword", [1.0, 0.0]) for i in range(15)] + [(50, None, None)])
    hits = s.search(chunks, docs, tags, [1.0, 0.0], "shared keyword")
    pages = [[r["chunk_id"] for r in s.page(hits, 5, o).collect()] for o in (0, 5, 100)]
    assert hits.count() == 15 and len(set(pages[0] + pages[1])) == 10 and pages[2] == []
    assert s.search(chunks, docs, tags, None, "shared", s.SearchOptions(tags=["y"])).count() == 1
    assert s.search(chunks, docs, tags, None, "shared", s.SearchOptions(source="/d/1")).count() == 6
    assert s.search(chunks, docs, tags, None, "", None).count() == 0
    assert s.search(*store(spark, []), [1.0], "shared").count() == 0


def test_bm25_formula_and_phrase(spark):
    chunks = store(spark, [(1, "error-rate of error", None), (2, "rate error", None), (3, "x y z", None)])[0]
    got = {r["chunk_id"]: r["bm25"] for r in indexed(chunks).bm25(s.parse_query(spark, "error-rate")).collect()}
    idf = math.log((3 - 1 + 0.5) / 1.5)
    assert set(got) == {"1:0"} and abs(got["1:0"] + idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 4 / 3))) < 1e-12


def test_index_is_kept_with_its_chunks(spark):
    rows = [(1, "red apple", None), (2, "green apple pie", None), (3, None, None)]
    chunks = store(spark, rows)[0]
    index = indexed(chunks.where("chunk_id != '3:0'"))
    index.add(chunks)  # only what it lacks
    again = TextIndex(spark, index.path)
    assert again.lengths().count() == 3 and again.postings(["apple", "pie", "none"]).count() == 3
    again.remove(chunks.where("chunk_id = '1:0'"))
    again.add(store(spark, [(4, "apple", None)])[0])
    assert {r.chunk_id for r in again.bm25([["apple"]]).collect()} == {"2:0", "4:0"} and again.lengths().count() == 3
    assert indexed(chunks.limit(0)).bm25([["apple"]]).count() == 0 and index.bm25([]).count() == 0
    scan = again.postings(["apple"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in scan or "PartitionFilters: [(bucket" in scan or "PartitionFilters: [bucket" in scan


def test_context_never_leaves_the_document(spark):
    t = spark.createDataFrame([(f"{d}:{i}", d, i, "t", None) for d in (1, 2) for i in range(4)], CHUNKS)
    mid = spark.createDataFrame([("1:0",), ("1:0",), ("2:9",)], "chunk_id string")
    assert sorted(r["chunk_id"] for r in s.chunk_context(t, mid, 2, 1).collect()) == ["1:0", "1:1"]


def test_cosine_and_blobs(spark):
    rows = [([1.0, 2.0], [1.0, 2.0], 1.0), ([1.0, 0.0], [0.0, 1.0], 0.0), ([1.0, 0.0], [-1.0, 0.0], -1.0), ([], [], 0.0), ([1.0], [1.0, 2.0], 0.0), ([0.0], [0.0], 0.0)]
    df = spark.createDataFrame(rows, "a array<float>, b array<float>, want double")
    assert all(abs(r["c"] - r["want"]) < 1e-9 for r in df.select("want", cosine(F.col("a"), F.col("b")).alias("c")).collect())
    back = df.select(F.col("a"), from_blob(to_blob(F.col("a"))).alias("b")).collect()
    assert all(list(r["a"]) == list(r["b"]) for r in back)


def test_text_functions(spark):
    one = spark.range(1)
    val = lambda c: one.select(c.alias("v")).first()["v"]
    assert [val(humanize_bytes(F.lit(n))) for n in (0, 1024, 1536, 2**20, 2**30)] == ["0.0 B", "1.0 KB", "1.5 KB", "1.0 MB", "1.0 GB"]
    assert [val(approximate_tokens(F.lit(t))) for t in ("", "abcd", "hello world, this is a test")] == [0, 1, 6]
    assert val(query_terms(F.lit('say "hi" a quartzmeadow.studio'))) == ["say", "hi", "quartzmeadow.studio"]
    assert val(strip_html(F.lit("<p>a&amp;b</p><script>x</script> c <unclosed"))) == "a&amp;b c "
    assert val(collapse_whitespace(F.lit("  a \n\n\n b\n"))) == "a\nb\n"
    assert val(derive_title(F.lit("\n  " + "t" * 90))) == "t" * 77 + "..." and val(derive_title(F.lit(None).cast("string"))) == "(untitled)"


def test_split_rank_matches_row_number(spark):
    df = spark.createDataFrame([("g", x % 7, x) for x in range(50)] + [("h", None, 1), ("h", 3, 2)], "g string, v int, id int")
    out = split_rank(df, ["g"], [F.col("v").asc_nulls_first(), F.col("id")], F.col("v"), "n").collect()
    for g in ("g", "h"):
        rows = sorted((r for r in out if r["g"] == g), key=lambda r: (-1 if r["v"] is None else r["v"], r["id"]))
        assert [r["n"] for r in rows] == list(range(len(rows)))
