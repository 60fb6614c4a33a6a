from datetime import datetime, timezone

from pyspark.sql import functions as F

from marlstone.operators.timezones import normalise_stamps

SCHEMA = "k int, stamp string, tz string, path string"


def utc(*parts, micro=0):
    return int(datetime(*parts, tzinfo=timezone.utc).timestamp()) * 1_000_000 + micro


def run(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA)
    out = normalise_stamps(df, "stamp", "tz", group=F.col("path")).orderBy("k").collect()
    return [(r["utc_micros"], r["zone_case"]) for r in out]


def test_notations_zones_and_dst(spark):
    rows = [
        ("2024-03-10T12:00:00.1234567Z", None, None),
        ("Sat, 11 Dec 2021 08:44:29 +0100", "Asia/Tokyo", None),
        ("2023-07-01 10:00:00 EST", None, None),
        ("25.07.2024 20:36", "Europe/Berlin", None),
        ("2024-10-27 02:30:00", "Europe/Berlin", None),  # occurs twice: the first
        ("2024-03-31 02:30:00", "Europe/Berlin", None),  # skipped: moves forward
        ("2024-01-01 00:00:00", "No/Zone", None),
        ("1650001234.1234569", None, None),
        ("1650001234123", None, None),
        ("Jul 23, 2024 12:52:42 AM", None, None),
        ("‎ 20240816T145401\t", None, None),
    ]
    want = [
        (utc(2024, 3, 10, 12, micro=123456), "stated"),
        (utc(2021, 12, 11, 7, 44, 29), "stated"),
        (utc(2023, 7, 1, 15), "stated"),
        (utc(2024, 7, 25, 18, 36), "direct"),
        (utc(2024, 10, 27, 0, 30), "ambiguous"),
        (utc(2024, 3, 31, 1, 30), "nonexistent"),
        (utc(2024, 1, 1), "utc"),
        (1650001234123456, "epoch"),
        (1650001234123000, "epoch"),
        (utc(2024, 7, 23, 0, 52, 42), "utc"),
        (utc(2024, 8, 16, 14, 54, 1), "utc"),
    ]
    assert run(spark, rows) == want


def test_order_of_day_and_month_per_group(spark):
    rows = [("3/4/24, 10:00", None, "a"), ("3/14/24, 10:00", None, "a"), ("3/4/24, 10:00", None, "b"), ("14/3/24, 10:00", None, "b"), ("31/02/2023, 10:00", None, "a")]
    got = [r[0] for r in run(spark, rows)]
    assert got == [utc(2024, 3, 4, 10), utc(2024, 3, 14, 10), utc(2024, 4, 3, 10), utc(2024, 3, 14, 10), None]


def test_unreadable_null_and_empty(spark):
    rows = [(s, "UTC", None) for s in (None, "", "  ", "soon", "2023-02-30T10:00:00Z", "0000-00-00 00:00:00", "2022-13-05 08:00:00", "2024-01-01 24:00:00", "x" * 10000)]
    assert [r[0] for r in run(spark, rows)] == [None] * len(rows)
    assert run(spark, []) == []


def test_years_far_from_now(spark):
    rows = [("1965-07-01 12:00:00", "America/New_York", None), ("2150-07-01 12:00:00", "Asia/Tokyo", None), ("2150-07-01 12:00:00", "America/New_York", None),
            ("9999-01-15 12:00:00", "Europe/Berlin", None), ("1750-01-01 12:00:00", "Europe/London", None), ("1883-11-18 12:30:00", "America/New_York", None)]
    want = [(utc(1965, 7, 1, 16), "direct"), (utc(2150, 7, 1, 3), "direct"), (utc(2150, 7, 1, 16), "direct"), (utc(9999, 1, 15, 11), "direct"), (utc(1750, 1, 1, 12, 1, 15), "direct"), (utc(1883, 11, 18, 17, 30), "direct")]
    assert run(spark, rows) == want


def test_rows_of_one_group_and_rows_without_one(spark):
    rows = [(f"{k % 12 + 1}/{k % 28 + 1}/24, 10:0{k % 10}", None, "hot") for k in range(200)] + [("3/4/24, 10:00", None, None)] * 50
    got = run(spark, rows)
    assert [r[0] for r in got[:200]] == [utc(2024, k % 12 + 1, k % 28 + 1, 10, k % 10) for k in range(200)]
    assert {r[0] for r in got[200:]} == {utc(2024, 4, 3, 10)}
