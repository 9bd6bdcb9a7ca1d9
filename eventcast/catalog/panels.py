"""Aggregation, densification, statistics and set queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventcast import schema as S
from eventcast.catalog import sqltext as Q
from eventcast.catalog.cleaning import PREDICTED, predicted_type
from eventcast.catalog.registry import query
from eventcast.operators import evaluate, panel, stats
from eventcast.plans import features
from eventcast.functions import calendar as C
from eventcast.session import new_path
from eventcast.sources import tables as T

MEASURES = "attack_count long, total_casualties double, total_killed double, total_wounded double"
SUMS = """count(*) AS attack_count, sum(casualties) AS total_casualties, sum(nkill) AS total_killed,
  sum(nwound) AS total_wounded"""


@query("d1_daily_counts", f"date date, region_txt string, {MEASURES}",
       f"WITH {Q.FEAT} SELECT date, region_txt, {SUMS} FROM feat GROUP BY 1, 2")
def d1(s, d):
    return panel.aggregate_daily(T.featured_incidents(s, d), "region_txt")


@query("d2_weekly_counts", f"week_start date, country_txt string, {MEASURES}, first_attack_date date, year int, week int",
       f"""WITH {Q.weekly('country_txt')} SELECT *, series AS country_txt, year(week_start) AS year,
       weekofyear(week_start) AS week FROM wk""")
def d2(s, d):
    return panel.aggregate_weekly(T.featured_incidents(s, d), "country_txt")


@query("d3_monthly_counts", f"month_start date, attacktype1_txt string, {MEASURES}, year int, month int",
       f"""WITH {Q.FEAT}, m AS (SELECT CAST(date_trunc('month', date) AS DATE) AS month_start, attacktype1_txt, {SUMS}
       FROM feat GROUP BY 1, 2) SELECT *, year(month_start) AS year, month(month_start) AS month FROM m""")
def d3(s, d):
    return panel.aggregate_monthly(T.featured_incidents(s, d), "attacktype1_txt")


@query("d4_grain_switch", f"grain string, series string, {MEASURES}",
       f"WITH {Q.FEAT} " + " UNION ALL ".join(
           f"SELECT '{g}' AS grain, {c} AS series, {SUMS} FROM feat GROUP BY 2"
           for g, c in [("region", "region_txt"), ("country", "country_txt"),
                        ("attack_type", "attacktype1_txt"), ("other", "region_txt")]))
def d4(s, d):
    # One pass for the finest keys, then each grain rolls up from it.
    events = T.featured_incidents(s, d)
    cells = events.groupBy("region_txt", "country_txt", "attacktype1_txt").agg(
        F.count("eventid").alias("attack_count"), F.sum("casualties").alias("total_casualties"),
        F.sum("nkill").alias("total_killed"), F.sum("nwound").alias("total_wounded"),
    )
    tagged = cells.select(*S.PANEL_MEASURES, F.inline(F.array(*[
        F.struct(F.lit(g).alias("grain"), F.col(S.grain_column(g)).alias("series"))
        for g in ("region", "country", "attack_type", "other")
    ])))
    return tagged.groupBy("grain", "series").agg(*[F.sum(m).alias(m) for m in S.PANEL_MEASURES])


@query("d5_dense_weekly", f"country_txt string, week_start date, {MEASURES}, first_attack_date date",
       f"WITH {Q.weekly('country_txt')} SELECT *, series AS country_txt FROM panel")
def d5(s, d):
    weekly = panel.aggregate_weekly(T.featured_incidents(s, d), "country_txt")
    return panel.fill_missing_periods(weekly, "week_start", "country_txt", "week")


@query("d5_dense_daily_types", "event_type string, date date, n long",
       """WITH c AS (SELECT event_type, CAST(ts AS DATE) AS date, count(*) AS n FROM events GROUP BY 1, 2),
       g AS (SELECT event_type, CAST(t AS DATE) AS date FROM (SELECT DISTINCT event_type FROM c),
             (SELECT unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS t FROM c))
       SELECT event_type, date, coalesce(n, 0) AS n FROM g LEFT JOIN c USING (event_type, date)""")
def d5_daily(s, d):
    daily = T.table(s, d, "events").groupBy("event_type", F.to_date("ts").alias("date")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return panel.fill_missing_periods(daily, "date", "event_type", "day", ["n"])


@query("d5_dense_monthly", f"country_txt string, month_start date, {MEASURES}",
       f"""WITH {Q.FEAT}, m AS (SELECT CAST(date_trunc('month', date) AS DATE) AS month_start, country_txt, {SUMS}
       FROM feat GROUP BY 1, 2),
       g AS (SELECT country_txt, CAST(t AS DATE) AS month_start FROM (SELECT DISTINCT country_txt FROM m),
             (SELECT unnest(generate_series(min(month_start), max(month_start), INTERVAL 1 MONTH)) AS t FROM m))
       SELECT country_txt, month_start, coalesce(attack_count, 0) AS attack_count,
         coalesce(total_casualties, 0) AS total_casualties, coalesce(total_killed, 0) AS total_killed,
         coalesce(total_wounded, 0) AS total_wounded FROM g LEFT JOIN m USING (country_txt, month_start)""")
def d5_monthly(s, d):
    monthly = panel.aggregate_monthly(T.featured_incidents(s, d), "country_txt")
    return panel.fill_missing_periods(monthly, "month_start", "country_txt", "month")


@query("d6_weekly_panel", Q.PANEL_COLUMNS, f"WITH {Q.full_panel()} SELECT *, series AS region_txt FROM full_panel")
def d6(s, d):
    return panel.aggregate_data(T.featured_incidents(s, d), "region")["weekly"]


@query("d6_monthly_panel", f"month_start date, region_txt string, {MEASURES}, year int, month int",
       f"""WITH {Q.FEAT}, m AS (SELECT CAST(date_trunc('month', date) AS DATE) AS month_start, region_txt, {SUMS}
       FROM feat GROUP BY 1, 2) SELECT *, year(month_start) AS year, month(month_start) AS month FROM m""")
def d6_monthly(s, d):
    return panel.aggregate_data(T.featured_incidents(s, d), "region")["monthly"]


RESAMPLED = "period_end date, nkill double, nwound double, casualties double"


def _resampled(unit: str, step: str, end: str, name: str) -> str:
    return f"""WITH {Q.FEAT}, p AS (SELECT CAST(date_trunc('{unit}', date) AS DATE) AS st, sum(nkill) AS nkill,
      sum(nwound) AS nwound, sum(casualties) AS casualties, count(*) AS {name} FROM feat GROUP BY 1),
    g AS (SELECT CAST(t AS DATE) AS st FROM (SELECT unnest(generate_series(min(st), max(st), INTERVAL {step})) AS t FROM p))
    SELECT {end} AS period_end, coalesce(nkill, 0) AS nkill, coalesce(nwound, 0) AS nwound,
      coalesce(casualties, 0) AS casualties, coalesce({name}, 0) AS {name} FROM g LEFT JOIN p USING (st)"""


@query("d7_weekly_resample", f"{RESAMPLED}, Weekly_Attacks long",
       _resampled("week", "7 DAY", "st + 6", "Weekly_Attacks"))
def d7(s, d):
    return panel.resample(T.featured_incidents(s, d), ["nkill", "nwound", "casualties"], "week", "Weekly_Attacks")


@query("d8_monthly_resample", f"{RESAMPLED}, Monthly_Attacks long",
       _resampled("month", "1 MONTH", "last_day(st)", "Monthly_Attacks"))
def d8(s, d):
    return panel.resample(T.featured_incidents(s, d), ["nkill", "nwound", "casualties"], "month", "Monthly_Attacks")


@query("d9_series_summary", "n long, first_date date, last_date date, mean r6, std r6",
       f"""WITH {Q.weekly()} SELECT count(*) AS n, min(week_start) AS first_date, max(week_start) AS last_date,
       avg(attack_count) AS mean, stddev_pop(attack_count) AS std FROM panel""")
def d9(s, d):
    weekly = panel.aggregate_weekly(T.featured_incidents(s, d), "region_txt")
    return stats.series_summary(
        panel.fill_missing_periods(weekly, "week_start", "region_txt", "week"), "week_start", "attack_count"
    )


@query("d10_describe", "count long, mean r6, std r6, min double, q25 r6, q50 r6, q75 r6, max double",
       f"""WITH {Q.FEAT} SELECT count(casualties) AS count, avg(casualties) AS mean, stddev_samp(casualties) AS std,
       min(casualties) AS min, quantile_cont(casualties, 0.25) AS q25, quantile_cont(casualties, 0.5) AS q50,
       quantile_cont(casualties, 0.75) AS q75, max(casualties) AS max FROM feat""")
def d10(s, d):
    return stats.describe(T.featured_incidents(s, d).select("casualties"), "casualties")


@query("d10_describe_price", "count long, mean r6, std r6, min double, q25 r6, q50 r6, q75 r6, max double",
       """SELECT count(o_totalprice) AS count, avg(o_totalprice) AS mean, stddev_samp(o_totalprice) AS std,
       min(o_totalprice) AS min, quantile_cont(o_totalprice, 0.25) AS q25, quantile_cont(o_totalprice, 0.5) AS q50,
       quantile_cont(o_totalprice, 0.75) AS q75, max(o_totalprice) AS max FROM orders""")
def d10_price(s, d):
    return stats.describe(T.table(s, d, "orders").select("o_totalprice"), "o_totalprice")


@query("d11_flag_rates", "flag string, total double, rate r6",
       f"""WITH {Q.INC}, c AS (SELECT CASE WHEN isodow(date) >= 6 THEN 1 ELSE 0 END AS is_weekend,
       CASE WHEN month(date) = 12 AND day(date) = 25 OR month(date) = 7 AND day(date) = 4 OR month(date) = 1 AND day(date) = 1
         OR month(date) = 5 AND isodow(date) = 1 AND day(date) >= 25 OR month(date) = 9 AND isodow(date) = 1 AND day(date) <= 7
         OR month(date) = 11 AND isodow(date) = 4 AND day(date) BETWEEN 22 AND 28 THEN 1 ELSE 0 END AS is_us_holiday FROM inc)
       SELECT 'is_weekend' AS flag, sum(is_weekend) AS total, avg(is_weekend) AS rate FROM c UNION ALL
       SELECT 'is_us_holiday', sum(is_us_holiday), avg(is_us_holiday) FROM c""")
def d11(s, d):
    events = T.incidents(s, d, casualties=False).transform(features.temporal).withColumn(
        "is_us_holiday", C.us_holiday(F.col("date"))
    )
    return stats.flag_summary(events, ["is_weekend", "is_us_holiday"])


@query("d12_value_counts", "weaptype1_txt string, n long, percent r6",
       f"""WITH {Q.INC} SELECT weaptype1_txt, count(*) AS n, count(*) * 100.0 / sum(count(*)) OVER () AS percent
       FROM inc GROUP BY 1""")
def d12(s, d):
    return stats.value_counts(T.incidents(s, d, casualties=False), "weaptype1_txt")


@query("d13_box_stats", """region_txt string, q1 r6, median r6, q3 r6, low_whisker double, high_whisker double,
outliers long""",
       f"""WITH {Q.FEAT}, q AS (SELECT region_txt, quantile_cont(casualties, 0.25) AS q1,
         quantile_cont(casualties, 0.5) AS median, quantile_cont(casualties, 0.75) AS q3 FROM feat GROUP BY 1),
       j AS (SELECT *, casualties BETWEEN q1 - (q3 - q1) * 1.5 AND q3 + (q3 - q1) * 1.5 AS inside
             FROM feat JOIN q USING (region_txt))
       SELECT region_txt, q1, median, q3, min(casualties) FILTER (WHERE inside) AS low_whisker,
         max(casualties) FILTER (WHERE inside) AS high_whisker, count(*) FILTER (WHERE NOT inside) AS outliers
       FROM j GROUP BY 1, 2, 3, 4""")
def d13(s, d):
    return stats.box_stats(T.featured_incidents(s, d), "casualties", "region_txt")


CORRELATED = ["nkill", "nwound", "casualties", "latitude", "longitude"]


@query("d14_correlation", "row_name string, column_name string, correlation r6",
       f"WITH {Q.FEAT} " + " UNION ALL ".join(
           f"SELECT '{a}' AS row_name, '{b}' AS column_name, corr({a}, {b}) AS correlation FROM feat"
           for a in CORRELATED for b in CORRELATED))
def d14(s, d):
    return stats.correlation_matrix(T.featured_incidents(s, d), CORRELATED)


# Prices and parts of them by many divisors, with nulls in different rows of each.
DIVISORS = [p for p in range(2, 200) if all(p % q for q in range(2, p))][:40]


@query("d14_correlation_wide", "row_name string, column_name string, correlation r6",
       "WITH wide AS (SELECT " + ", ".join(
           f"CASE WHEN o_orderkey % {p} <> 1 THEN o_totalprice % {100 * p} END AS part{p}" for p in DIVISORS) + " FROM orders) "
       + "SELECT unnest([" + ", ".join(f"'part{a}'" for a in DIVISORS for _ in DIVISORS) + "]) AS row_name, unnest(["
       + ", ".join(f"'part{b}'" for _ in DIVISORS for b in DIVISORS) + "]) AS column_name, unnest(["
       + ", ".join(f"corr(part{a}, part{b})" for a in DIVISORS for b in DIVISORS) + "]) AS correlation FROM wide")
def d14_wide(s, d):
    orders = T.table(s, d, "orders")
    parts = orders.select(*[F.when(F.col("o_orderkey") % p != 1, F.col("o_totalprice") % (100 * p)).alias(f"part{p}") for p in DIVISORS])
    return stats.correlation_matrix(parts, parts.columns)


@query("d15_sum_by_country", "country_txt string, total double",
       f"WITH {Q.FEAT} SELECT country_txt, sum(casualties) AS total FROM feat GROUP BY 1")
def d15(s, d):
    return stats.sum_by(T.featured_incidents(s, d), "country_txt", "casualties")


@query("d16_grid_histogram", "latitude_cell long, longitude_cell long, n long",
       f"""WITH {Q.INC} SELECT floor(latitude / 10) AS latitude_cell, floor(longitude / 10) AS longitude_cell,
       count(*) AS n FROM inc GROUP BY 1, 2""")
def d16(s, d):
    return stats.grid_histogram(T.incidents(s, d, casualties=False), "latitude", "longitude", 10)


@query("d17_distinct_counts", "column_name string, n_distinct long",
       f"WITH {Q.INC} " + " UNION ALL ".join(
           f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS n_distinct FROM inc"
           for c in ("country_txt", "city", "attacktype1_txt", "date")))
def d17(s, d):
    return stats.distinct_count(
        T.incidents(s, d, casualties=False), ["country_txt", "city", "attacktype1_txt", "date"]
    )


@query("d17_distinct_approx", "column_name string, n_distinct long")
def d17_approx(s, d):
    return stats.distinct_count(
        T.incidents(s, d, casualties=False), ["country_txt", "city", "date"], approximate=True
    )


SKETCHED = ["country_txt", "city", "date"]


@query("d17_distinct_sketches", "year int, column_name string, n_distinct long, within boolean",
       f"WITH {Q.INC} " + " UNION ALL ".join(
           f"SELECT year(date) AS year, '{c}' AS column_name, count(DISTINCT {c}) AS n_distinct, true AS within FROM inc GROUP BY 1"
           for c in SKETCHED))
def d17_sketches(s, d):
    """Daily sketches, stored and united by year, next to exact counts: ``within`` their error."""
    events = T.incidents(s, d, casualties=False).select(*SKETCHED)
    path = new_path(s, "sketches")
    stats.distinct_sketches(events.withColumn("day", F.col("date")), "day", SKETCHED).write.parquet(path)
    united = stats.distinct_united(s.read.parquet(path).withColumn("year", F.year("day")), ["year"])
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in SKETCHED])
    exact = events.select(F.year("date").alias("year"), F.inline(cells)).distinct().groupBy("year", "column_name").agg(
        F.count("value").alias("exact"))
    found = exact.join(united, ["year", "column_name"], "left")
    close = F.abs(F.col("n_distinct") - F.col("exact")) <= F.ceil(F.col("exact") * stats.sketch_error())
    return found.select("year", "column_name", F.col("exact").alias("n_distinct"), F.coalesce(close, F.lit(False)).alias("within"))


@query("d18_predicted_geography", "predicted_label string, latitude_cell long, longitude_cell long, n long",
       f"""WITH {Q.INC}, p AS (SELECT *, {PREDICTED} AS predicted_label FROM inc)
       SELECT predicted_label, floor(latitude / 10) AS latitude_cell, floor(longitude / 10) AS longitude_cell,
       count(*) AS n FROM p GROUP BY 1, 2, 3""")
def d18(s, d):
    events = T.incidents(s, d, casualties=False)
    predictions = events.select("eventid", predicted_type().alias("predicted_label"))
    return stats.grid_histogram(
        evaluate.attach_predictions(events, predictions, "eventid"), "latitude", "longitude", 10, ["predicted_label"]
    )


@query("u3_distinct_locations", "country_txt string, region_txt string, city string",
       f"WITH {Q.INC} SELECT DISTINCT country_txt, region_txt, city FROM inc")
def u3(s, d):
    return T.incidents(s, d, casualties=False).select("country_txt", "region_txt", "city").distinct()


@query("k1_sorted_events", "country_txt string, date date, eventid long",
       f"WITH {Q.INC} SELECT country_txt, date, eventid FROM inc ORDER BY 1, 2, 3")
def k1(s, d):
    return T.incidents(s, d, casualties=False).select("country_txt", "date", "eventid").orderBy(
        "country_txt", "date", "eventid"
    )


