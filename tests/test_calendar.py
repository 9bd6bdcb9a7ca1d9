import pytest
from pyspark.sql import functions as F

from eventcast.functions import calendar as C
from eventcast.operators.evaluate import attach_holidays

HOLIDAYS = ["2001-01-01", "2001-07-04", "2001-12-25", "2001-05-28", "2001-09-03", "2001-11-22"]
ORDINARY = ["2001-01-02", "2001-07-05", "2001-12-24", "2001-05-21", "2001-09-10", "2001-11-29", "2001-11-15"]


def test_us_holidays(spark, day):
    rows = spark.createDataFrame([(day(d),) for d in HOLIDAYS + ORDINARY], "d date")
    found = {str(r["d"]): r["h"] for r in rows.withColumn("h", C.us_holiday(F.col("d"))).collect()}
    assert {d for d, h in found.items() if h == 1} == set(HOLIDAYS)


@pytest.mark.parametrize("text, week, weekday", [("1969-12-29", 1, 0), ("2016-01-03", 53, 6), ("2000-02-29", 9, 1)])
def test_iso_week_and_weekday(spark, day, text, week, weekday):
    parts = C.temporal_features(F.col("d"))
    row = spark.createDataFrame([(day(text),)], "d date").select(
        parts["week_of_year"].alias("w"), parts["day_of_week"].alias("k"), parts["is_weekend"].alias("e")
    ).first()
    assert (row["w"], row["k"], row["e"]) == (week, weekday, int(weekday >= 5))


def test_week_end_is_sunday(spark, day):
    row = spark.createDataFrame([(day("2001-09-11"),)], "d date").select(
        C.week_end(F.col("d")).alias("e"), C.period_start(F.col("d"), "week").alias("s")
    ).first()
    assert (row["s"], row["e"]) == (day("2001-09-10"), day("2001-09-16"))


def test_holiday_calendar_join(spark, day):
    events = spark.createDataFrame(
        [(1, "A", day("2001-01-01")), (2, "A", day("2001-01-02")), (3, "Z", day("2001-01-01"))],
        "eventid long, country_txt string, date date",
    )
    codes = spark.createDataFrame([("A", "AA")], "country_txt string, country_code string")
    holidays = spark.createDataFrame(
        [("AA", day("2001-01-01")), ("AA", day("2001-01-01"))], "country_code string, date date"
    )
    found = {r["eventid"]: r["is_holiday"] for r in attach_holidays(events, codes, holidays).collect()}
    assert found == {1: 1, 2: 0, 3: 0}
