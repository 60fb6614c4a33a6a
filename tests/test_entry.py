import __spark_entry__ as e


def test_every_oracle_has_a_query(spark):
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).limit(1).count() == 1
