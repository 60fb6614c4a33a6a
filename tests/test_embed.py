import numpy as np
from pyspark.sql import functions as F

from marlstone.functions.embed import bounded_ids, embed, pooled
from marlstone.functions.text import file_stem


def test_pooling_and_bounds():
    tokens = np.array([[[3.0, 4.0], [0.0, 2.0], [9.0, 9.0]], [[0.0, 0.0], [1.0, 1.0], [1.0, 1.0]]])
    mask = np.array([[1, 1, 0], [0, 0, 0]])
    assert np.allclose(pooled(tokens, mask, "bge-small-en-v1.5"), [[0.6, 0.8], [0, 0]])
    assert np.allclose(pooled(tokens, mask, "all-minilm-l6"), [np.array([1.5, 3.0]) / np.hypot(1.5, 3.0), [0, 0]])
    assert bounded_ids([1, 2, 3], 3) == [1, 2, 3] and bounded_ids([1, 2, 3, 4], 3) == [1, 2, 102] and bounded_ids([]) == []


def test_any_model_plugs_in(spark):
    df = spark.createDataFrame([("a b",), ("",), (None,)], "t string")
    fixed = lambda: lambda texts: np.tile(np.eye(1, 4), (len(texts), 1))
    assert [r.v for r in df.select(embed(F.col("t"), fixed).alias("v")).collect()] == [[1, 0, 0, 0], [1, 0, 0, 0], None]


def test_file_stems(spark):
    df = spark.createDataFrame([("/a/b.tar.gz",), ("notes.md",), ("/x/README",), ("/x/.md",), ("/x/",)], "p string")
    assert [r.s for r in df.select(file_stem(F.col("p")).alias("s")).collect()] == ["b.tar", "notes", "README", ".md", "untitled"]
