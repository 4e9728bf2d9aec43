import datetime as dt

from pyspark.sql import functions as F

from ledgerloom.functions.parse import fixed, parse_amount_prefix, parse_amount_whole, parse_ts


def _one(spark, values, expr):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [r["x"] for r in rows.select("i", expr(F.col("s")).alias("x")).orderBy("i").collect()]


def test_dates(spark):
    texts = ["1/2/24 9:05", "01/02/24 09:05:07", "1/2/24", "1/2/2024", "1/2/2024 9:05", "2024-01-02", "2024-01-02T09:05:07", "  1/2/24  ", "1/2/70", "1/2/68", "2/30/24", "", "bad", None]
    day = dt.datetime(2024, 1, 2)
    want = [day.replace(hour=9, minute=5), day.replace(hour=9, minute=5, second=7), day, day, day.replace(hour=9, minute=5), day, day.replace(hour=9, minute=5, second=7), day, dt.datetime(1970, 1, 2), dt.datetime(2068, 1, 2), None, None, None, None]
    assert _one(spark, texts, parse_ts) == want


def test_amounts(spark):
    got = _one(spark, ["12abc", " 12 ", "1,234", "", "-50", ".5e1x", "$5", None, "inf", "-inf", "1e999"], parse_amount_prefix)
    assert got == [12.0, 12.0, 1.0, None, -50.0, 5.0, None, None, float("inf"), float("-inf"), None]
    assert _one(spark, ["12abc", " 12 ", "1,234", "-5e1", "1d", "1f", "2L", "nan", "-inf", ".5", "5.", "."], parse_amount_whole) == [None, 12.0, None, -50.0, None, None, None, None, float("-inf"), 0.5, 5.0, None]
    [nan] = _one(spark, ["NaN"], parse_amount_prefix)
    assert nan != nan


def test_fixed(spark):
    assert _one(spark, ["2", "-0.5"], lambda s: fixed(s.cast("double"), 2)) == ["2.00", "-0.50"]


def test_more_dates(spark):
    texts = ["2024-01-02 09:05", "2024-01-02 09:05:07", "2024-01-02T09:05", "2024-01-02 09:05:07.5", "x"]
    at = dt.datetime(2024, 1, 2, 9, 5)
    assert _one(spark, texts, lambda s: parse_ts(s, extra=True)) == [at, at.replace(second=7), at, at.replace(second=7, microsecond=500_000), None]
    assert _one(spark, texts[:1], parse_ts) == [None]
