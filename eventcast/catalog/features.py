"""Window queries over events and panels."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventcast.catalog import sqltext as Q
from eventcast.catalog.registry import query
from eventcast.operators import panel, rank, windows
from eventcast.plans import features
from eventcast.sources import tables as T

BY_COUNTRY = "PARTITION BY country_txt ORDER BY date, eventid"


@query("w1_days_since_last", "eventid long, country_txt string, date date, days_since_last int",
       f"""WITH {Q.INC} SELECT eventid, country_txt, date,
       coalesce(date_diff('day', lag(date) OVER ({BY_COUNTRY}), date), 0) AS days_since_last FROM inc""")
def w1(s, d):
    return windows.days_since_last(T.incidents(s, d, casualties=False))


@query("w1_days_since_last_region", "eventid long, region_txt string, days_since_last int",
       f"""WITH {Q.INC} SELECT eventid, region_txt,
       coalesce(date_diff('day', lag(date) OVER (PARTITION BY region_txt ORDER BY date, eventid), date), 0)
       AS days_since_last FROM inc""")
def w1_region(s, d):
    return windows.days_since_last(T.incidents(s, d, casualties=False), "region_txt")


@query("w1_recency_summary", "mean_days r6, max_days int",
       f"""WITH {Q.INC}, g AS (SELECT coalesce(date_diff('day', lag(date) OVER ({BY_COUNTRY}), date), 0) AS v FROM inc)
       SELECT avg(v) AS mean_days, max(v) AS max_days FROM g""")
def w1_summary(s, d):
    return windows.days_since_last(T.incidents(s, d, casualties=False)).agg(
        F.avg("days_since_last").alias("mean_days"), F.max("days_since_last").alias("max_days")
    )


def _recent(days: int) -> str:
    return f"""count(*) OVER (PARTITION BY country_txt ORDER BY date
      RANGE BETWEEN INTERVAL {days} DAY PRECEDING AND INTERVAL 1 DAY PRECEDING) AS attacks_last_{days}d"""


@query("w2_event_frequency", "eventid long, country_txt string, attacks_last_7d long, attacks_last_30d long, attacks_last_90d long",
       f"WITH {Q.INC} SELECT eventid, country_txt, {_recent(7)}, {_recent(30)}, {_recent(90)} FROM inc")
def w2(s, d):
    return windows.event_frequency(T.incidents(s, d, casualties=False))


@query("w3_region_features", "eventid long, region_avg_casualties r6, region_attack_count long",
       f"""WITH {Q.FEAT} SELECT eventid, avg(casualties) OVER (PARTITION BY region_txt) AS region_avg_casualties,
       count(*) OVER (PARTITION BY region_txt) AS region_attack_count FROM feat""")
def w3(s, d):
    return windows.region_features(T.featured_incidents(s, d))


@query("w4_attack_type_features", "eventid long, attacktype_avg_casualties r6",
       f"""WITH {Q.FEAT} SELECT eventid, avg(casualties) OVER (PARTITION BY attacktype1_txt)
       AS attacktype_avg_casualties FROM feat""")
def w4(s, d):
    return windows.attack_type_features(T.featured_incidents(s, d))


def _lags(over: str) -> str:
    return ", ".join(f"lag(casualties, {k}) OVER ({over}) AS casualties_lag_{k}" for k in (1, 7, 30))


@query("w5_global_lags", "eventid long, casualties_lag_1 double, casualties_lag_7 double, casualties_lag_30 double",
       f"WITH {Q.FEAT} SELECT eventid, {_lags('ORDER BY date, eventid')} FROM feat")
def w5(s, d):
    events = T.featured_incidents(s, d).select("eventid", "date", "casualties")
    return windows.event_lags(events, "casualties", order=["date", "eventid"])


@query("w5_series_lags", "eventid long, casualties_lag_1 double, casualties_lag_7 double, casualties_lag_30 double",
       f"WITH {Q.FEAT} SELECT eventid, {_lags(BY_COUNTRY)} FROM feat")
def w5_series(s, d):
    events = T.featured_incidents(s, d).select("eventid", "country_txt", "date", "casualties")
    return windows.event_lags(events, "casualties", order=["date", "eventid"], by=["country_txt"])


@query("w6_seasonal_lag", "country_txt string, week_start date, attack_count_lag_52 long",
       f"""WITH {Q.weekly('country_txt')} SELECT series AS country_txt, week_start,
       lag(attack_count, 52) OVER (PARTITION BY series ORDER BY week_start) AS attack_count_lag_52 FROM panel""")
def w6(s, d):
    weekly = panel.aggregate_weekly(T.featured_incidents(s, d), "country_txt")
    dense = panel.fill_missing_periods(weekly.drop("year", "week"), "week_start", "country_txt", "week")
    return windows.seasonal_lag(dense, "attack_count", by="country_txt", time="week_start")


@query("w7_rolling_stats", """region_txt string, week_start date, attack_count_rolling_mean_4 r6,
attack_count_rolling_std_4 r6, attack_count_rolling_mean_12 r6, attack_count_rolling_std_12 r6""",
       f"WITH {Q.full_panel()} SELECT series AS region_txt, * FROM full_panel")
def w7(s, d):
    weekly = panel.aggregate_weekly(T.featured_incidents(s, d), "region_txt")
    dense = panel.fill_missing_periods(weekly.drop("year", "week"), "week_start", "region_txt", "week")
    return windows.rolling_statistics(dense, "attack_count", by="region_txt", time="week_start")


ROWS3 = "(ORDER BY date, eventid ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"


def _rolling(c: str) -> str:
    return f"""lag({c}) OVER (ORDER BY date, eventid) AS {c}_lag1,
    CASE WHEN count({c}) OVER {ROWS3} = 3 THEN avg({c}) OVER {ROWS3} END AS {c}_rolling_mean,
    CASE WHEN count({c}) OVER {ROWS3} = 3 THEN {Q.std(c, ROWS3)} END AS {c}_rolling_std"""


@query("w8_event_rolling", """eventid long, nkill_lag1 double, nkill_rolling_mean r6, nkill_rolling_std r6,
nwound_lag1 double, nwound_rolling_mean r6, nwound_rolling_std r6""",
       f"WITH {Q.FEAT} SELECT eventid, {_rolling('nkill')}, {_rolling('nwound')} FROM feat")
def w8(s, d):
    events = T.featured_incidents(s, d).select("eventid", "date", "nkill", "nwound")
    return windows.event_rolling(events, ["nkill", "nwound"], order=["date", "eventid"])


@query("w9_lag_matrix", "region_txt string, week_start date, y double, lag_1 double, lag_2 double, lag_3 double, lag_4 double",
       f"""WITH {Q.weekly()}, m AS (SELECT series AS region_txt, week_start, attack_count AS y, """
       + ", ".join(f"lag(attack_count, {k}) OVER w AS lag_{k}" for k in range(1, 5))
       + " FROM panel WINDOW w AS (PARTITION BY series ORDER BY week_start)) SELECT * FROM m WHERE lag_4 IS NOT NULL")
def w9(s, d):
    weekly = panel.aggregate_weekly(T.featured_incidents(s, d), "region_txt")
    dense = panel.fill_missing_periods(weekly.drop("year", "week"), "week_start", "region_txt", "week")
    return windows.lag_matrix(dense, "attack_count", by="region_txt", time="week_start")


@query("x1_global_rank", "eventid long, position long",
       f"WITH {Q.INC} SELECT eventid, row_number() OVER (ORDER BY date, eventid) - 1 AS position FROM inc")
def x1(s, d):
    keys = T.incidents(s, d, casualties=False).select("date", "eventid")
    return rank.global_rank(keys, ["date", "eventid"])


@query("w_engineer_features", """eventid long, casualties double, day_of_week int, is_us_holiday int, days_since_last int,
attacks_last_7d long, attacks_last_30d long, region_avg_casualties r6, region_attack_count long,
attacktype_avg_casualties r6""",
       f"""WITH {Q.FEAT} SELECT eventid, casualties, isodow(date) - 1 AS day_of_week,
       CASE WHEN (month(date) = 1 AND day(date) = 1) OR (month(date) = 7 AND day(date) = 4)
         OR (month(date) = 12 AND day(date) = 25) OR (month(date) = 5 AND isodow(date) = 1 AND day(date) >= 25)
         OR (month(date) = 9 AND isodow(date) = 1 AND day(date) <= 7)
         OR (month(date) = 11 AND isodow(date) = 4 AND day(date) BETWEEN 22 AND 28) THEN 1 ELSE 0 END AS is_us_holiday,
       coalesce(date_diff('day', lag(date) OVER ({BY_COUNTRY}), date), 0) AS days_since_last,
       {_recent(7)}, {_recent(30)}, avg(casualties) OVER (PARTITION BY region_txt) AS region_avg_casualties,
       count(*) OVER (PARTITION BY region_txt) AS region_attack_count,
       avg(casualties) OVER (PARTITION BY attacktype1_txt) AS attacktype_avg_casualties FROM feat""")
def engineered(s, d):
    return features.engineer_features(T.incidents(s, d).fillna(0, subset=["nkill", "nwound"]))
