import pytest
from pyspark.sql import functions as F

from eventcast.operators import panel, windows as W


def ties(spark, day):
    return spark.createDataFrame([
        (1, "A", day("2001-01-01")), (2, "A", day("2001-01-05")), (3, "A", day("2001-01-05")),
        (4, "A", day("2001-01-05")), (5, "B", day("2001-01-03")), (6, "B", day("2001-02-03")),
        (7, "C", day("2001-01-01")), (8, "A", day("2001-01-06")),
    ], "eventid long, country_txt string, date date")


def test_recency_with_ties(spark, day):
    found = {r["eventid"]: r["days_since_last"] for r in W.days_since_last(ties(spark, day)).collect()}
    assert found == {1: 0, 2: 4, 3: 0, 4: 0, 5: 0, 6: 31, 7: 0, 8: 1}


def test_frequency_excludes_the_day_itself(spark, day):
    found = {r["eventid"]: (r["attacks_last_7d"], r["attacks_last_30d"]) for r in W.event_frequency(ties(spark, day)).collect()}
    assert found == {1: (0, 0), 2: (1, 1), 3: (1, 1), 4: (1, 1), 5: (0, 0), 6: (0, 0), 7: (0, 0), 8: (4, 4)}


def test_history_features_equal_the_single_operators(spark, day):
    events = ties(spark, day).withColumns({
        "region_txt": F.when(F.col("country_txt") == "C", "S").otherwise("R"),
        "attacktype1_txt": (F.col("eventid") % 2).cast("string"),
        "casualties": F.when(F.col("eventid") != 3, F.col("eventid").cast("double")),
    })
    single = (
        events.transform(W.days_since_last).transform(W.event_frequency)
        .transform(W.region_features).transform(W.attack_type_features)
    )
    shared = W.history_features(events)
    names = sorted(single.columns)
    assert sorted(map(str, shared.select(names).collect())) == sorted(map(str, single.select(names).collect()))


def gaps(spark, day):
    return spark.createDataFrame([
        ("A", day("2001-01-01"), 1), ("A", day("2001-01-15"), 3), ("A", day("2001-01-22"), 4),
        ("B", day("2001-01-08"), 5), ("C", day("2001-01-01"), 7),
    ], "g string, week_start date, attack_count long")


def test_dense_grid_and_fill(spark, day):
    dense = panel.fill_missing_periods(gaps(spark, day), "week_start", "g", "week")
    assert dense.count() == 12
    assert dense.agg(F.sum("attack_count")).first()[0] == 20
    assert dense.filter("g = 'A' and week_start = '2001-01-08'").first()["attack_count"] == 0


def test_rolling_and_lag_on_panel(spark, day):
    dense = panel.fill_missing_periods(gaps(spark, day), "week_start", "g", "week")
    rows = (
        dense.transform(W.rolling_statistics, "attack_count", [4], by="g", time="week_start")
        .transform(W.seasonal_lag, "attack_count", 2, by="g", time="week_start")
        .filter("g = 'A'").orderBy("week_start").collect()
    )
    assert [r["attack_count_rolling_mean_4"] for r in rows] == pytest.approx([1, 0.5, 4 / 3, 2])
    assert rows[0]["attack_count_rolling_std_4"] is None
    assert rows[3]["attack_count_rolling_std_4"] == pytest.approx(1.8257418584)
    assert [r["attack_count_lag_2"] for r in rows] == [None, None, 1, 0]


def test_monthly_fill_and_resample(spark, day):
    events = spark.createDataFrame(
        [(1, "A", day("2001-01-31"), 2.0), (2, "A", day("2001-03-01"), 3.0)],
        "eventid long, g string, date date, casualties double",
    )
    months = panel.resample(events, ["casualties"], "month", "n").orderBy("period_end").collect()
    assert [(str(r["period_end"]), r["casualties"], r["n"]) for r in months] == [
        ("2001-01-31", 2.0, 1), ("2001-02-28", 0.0, 0), ("2001-03-31", 3.0, 1)]
    weeks = panel.resample(events, ["casualties"], "week", "n")
    assert weeks.count() == 5 and weeks.agg(F.sum("n")).first()[0] == 2
