from pyspark.sql import functions as F

from marlstone.functions.embed import embed
from marlstone.operators import sessions
from marlstone.operators.prefilter import likely_in


def test_bursts_break_on_users_gaps_and_threads(spark):
    rows = [(0, "U1", 0, False), (1, "U1", 10, False), (2, "U1", 20, False), (3, "U2", 25, False), (4, "U1", 200, False), (5, "U1", 210, True), (6, "U1", 215, False), (7, "", 216, False), (8, "", 217, False), (9, None, 218, False)]
    df = spark.createDataFrame(rows, "pos int, user string, second long, is_parent boolean").withColumn("g", F.lit(1))
    got = {r.pos: r.burst for r in sessions.bursts(df, ["g"], [F.col("pos")]).collect()}
    assert [got[k] for k in range(10)] == [0, 0, 0, 1, 2, 3, 4, 5, 6, 7]
    empty = df.where("pos < 0")
    assert sessions.bursts(empty, ["g"], [F.col("pos")]).count() == 0


def test_likely_in_loses_nothing(spark):
    df = spark.range(2000).withColumnRenamed("id", "k")
    wanted = spark.range(0, 2000, 7).withColumnRenamed("id", "k")
    passed = {r.k for r in likely_in(df, wanted, "k", 64).collect()}
    assert passed >= {r.k for r in wanted.collect()}
    assert likely_in(df, wanted.where("k < 0"), "k").count() == 0


def test_embedding_shapes(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, None), (3, "")], "k int, t string")
    got = {r.k: r.v for r in df.select("k", embed(F.col("t")).alias("v")).collect()}
    assert len(got[1]) == 384 and got[2] is None and set(got[3]) == {0.0} and abs(sum(x * x for x in got[1]) - 1) < 1e-6
