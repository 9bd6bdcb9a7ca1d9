"""Cleaning, lookup and calendar queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventcast import schema as S
from eventcast.catalog import sqltext as Q
from eventcast.catalog.registry import query
from eventcast.functions import calendar as C
from eventcast.operators import clean, evaluate, panel, windows
from eventcast.operators.attach import attach
from eventcast.sources import tables as T

RAW_TEXT = ("eventid long, iyear string, imonth string, iday string, country_txt string, "
            "region_txt string, city string, gname string, attacktype1_txt string, "
            "weaptype1_txt string")
RAW_NAMES = "eventid, iyear, imonth, iday, country_txt, region_txt, city, gname, attacktype1_txt, weaptype1_txt"


@query("b1_remove_duplicates", RAW_TEXT, f"WITH {Q.RAW} SELECT DISTINCT {RAW_NAMES} FROM raw")
def b1(s, d):
    return clean.remove_duplicates(T.raw_incidents(s, d))


CRITICAL = " AND ".join(f"{c} IS NOT NULL" for c in S.CRITICAL_COLUMNS)


@query("b2_critical_nulls", RAW_TEXT, f"WITH {Q.RAW} SELECT * FROM raw WHERE {CRITICAL}")
def b2(s, d):
    return clean.drop_critical_nulls(T.raw_incidents(s, d))


@query("b3_numeric_fill", "eventid long, nkill double, nwound double",
       f"WITH {Q.INC} SELECT eventid, coalesce(nkill, 0) AS nkill, coalesce(nwound, 0) AS nwound FROM inc")
def b3(s, d):
    return clean.fill_numeric_nulls(T.incidents(s, d))


@query("b4_categorical_fill", "eventid long, gname string, attacktype1_txt string, targtype1_txt string, weaptype1_txt string",
       f"""WITH {Q.RAW} SELECT eventid, coalesce(gname, 'Unknown') AS gname,
       coalesce(attacktype1_txt, 'Unknown') AS attacktype1_txt, targtype1_txt, weaptype1_txt FROM raw""")
def b4(s, d):
    return clean.fill_categorical_nulls(T.raw_incidents(s, d))


AUDITED = ["iyear", "imonth", "country_txt", "region_txt", "city", "gname", "attacktype1_txt",
           "longitude", "nkill", "nwound"]


@query("b5_null_audit", "column_name string, nulls long",
       f"WITH {Q.RAW} " + " UNION ALL ".join(
           f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS nulls FROM raw"
           for c in AUDITED))
def b5(s, d):
    return clean.null_audit(T.raw_incidents(s, d).select(*AUDITED))


@query("b6_types", "eventid long, iyear int, imonth int, iday int, nkill double, nwound double, latitude r6, longitude r6",
       f"WITH {Q.TYPED} SELECT * FROM typed")
def b6(s, d):
    return clean.fix_data_types(T.raw_incidents(s, d))


@query("b7_dates", "eventid long, date date, imonth int, iday int", f"WITH {Q.DATED} SELECT * FROM dated")
def b7(s, d):
    return T.raw_incidents(s, d).transform(clean.fix_data_types).transform(clean.create_date_column)


BAD = "coalesce(latitude < -90 OR latitude > 90, false) OR coalesce(longitude < -180 OR longitude > 180, false)"
LOCATED = f"""located AS (
  SELECT * REPLACE (CASE WHEN NOT ({BAD}) THEN latitude END AS latitude,
                    CASE WHEN NOT ({BAD}) THEN longitude END AS longitude) FROM"""


@query("b8_coordinates", "eventid long, latitude double, longitude double",
       f"WITH {Q.INC}, {LOCATED} inc) SELECT * FROM located")
def b8(s, d):
    return clean.validate_coordinates(T.incidents(s, d, casualties=False))


TIDIED = ", ".join(f"{Q.tidy(c)} AS {c}" for c in S.TEXT_COLUMNS)
TEXT_DECL = ", ".join(f"{c} string" for c in S.TEXT_COLUMNS)


@query("b9_text_fields", f"eventid long, {TEXT_DECL}", f"WITH {Q.RAW} SELECT eventid, {TIDIED} FROM raw")
def b9(s, d):
    return clean.standardize_text_fields(T.raw_incidents(s, d))


@query("b10_select_columns", "eventid long, date date, country_txt string, city string, nkill double",
       f"WITH {Q.INC} SELECT * FROM inc")
def b10(s, d):
    return clean.select_relevant_columns(T.incidents(s, d).withColumn("unwanted", F.lit(1)))


CLEANED = f"""{Q.DATED.replace('raw AS (', 'raw0 AS (').replace('FROM raw)', 'FROM (SELECT DISTINCT * FROM raw0))')},
complete AS (
  SELECT * REPLACE (coalesce(gname, 'Unknown') AS gname, coalesce(attacktype1_txt, 'Unknown') AS attacktype1_txt)
  FROM dated WHERE country_txt IS NOT NULL AND region_txt IS NOT NULL),
{LOCATED} complete),
cleaned AS (SELECT * REPLACE ({TIDIED}) FROM located)"""


@query("b11_clean_data", f"""eventid long, date date, iyear int, imonth int, iday int, {TEXT_DECL},
latitude r6, longitude r6, nkill double, nwound double""", f"WITH {CLEANED} SELECT * FROM cleaned")
def b11(s, d):
    return clean.clean_data(T.raw_incidents(s, d))


@query("b12_rename", 'Year string, Month string, Day string, Country string, Region string, AttackType string, Group string',
       f"""WITH {Q.RAW} SELECT iyear AS "Year", imonth AS "Month", iday AS "Day", country_txt AS "Country",
       region_txt AS "Region", attacktype1_txt AS "AttackType", gname AS "Group" FROM raw""")
def b12(s, d):
    return clean.rename_columns(T.raw_incidents(s, d))


@query("b13_median_impute", "eventid long, nkill double, nwound double",
       f"""WITH {Q.INC} SELECT eventid, coalesce(nkill, (SELECT median(nkill) FROM inc)) AS nkill,
       coalesce(nwound, (SELECT median(nwound) FROM inc)) AS nwound FROM inc""")
def b13(s, d):
    return clean.impute_median(T.incidents(s, d).select("eventid", "nkill", "nwound"), ["nkill", "nwound"])


@query("b14_remap", "eventid long, weaptype1_txt string",
       f"WITH {Q.INC} SELECT eventid, CASE WHEN weaptype1_txt = 'F' THEN 'Vehicle' ELSE weaptype1_txt END AS weaptype1_txt FROM inc")
def b14(s, d):
    labelled = T.incidents(s, d, casualties=False).withColumn(
        "weaptype1_txt", F.when(F.col("weaptype1_txt") == "F", S.LONG_VEHICLE_LABEL).otherwise(F.col("weaptype1_txt"))
    )
    return clean.remap_values(labelled, "weaptype1_txt", {S.LONG_VEHICLE_LABEL: "Vehicle"})


def _text_parts(s, d):
    return T.incidents(s, d, casualties=False).select(
        "eventid", F.year("date").cast("string").alias("Year"),
        F.when(F.col("eventid") % 31 == 0, "0").otherwise(F.month("date").cast("string")).alias("Month"),
        F.when(F.col("eventid") % 29 == 0, "0").otherwise(F.dayofmonth("date").cast("string")).alias("Day"),
    )


PADDED = f"""{Q.INC},
padded AS (
  SELECT eventid, CAST(year(date) AS VARCHAR) AS "Year",
    CASE WHEN eventid % 31 = 0 THEN '01' ELSE strftime(date, '%m') END AS "Month",
    CASE WHEN eventid % 29 = 0 THEN '01' ELSE strftime(date, '%d') END AS "Day" FROM inc)"""


@query("b15_padded_date", "eventid long, Month string, Day string, Date string",
       f"""WITH {PADDED} SELECT eventid, "Month", "Day", "Year" || '-' || "Month" || '-' || "Day" AS "Date" FROM padded""")
def b15(s, d):
    return clean.padded_date(_text_parts(s, d))


@query("b16_default_fill", "eventid long, city string, attacktype1_txt string, nkill string",
       f"""WITH {Q.RAW} SELECT eventid, coalesce(city, 'Unknown') AS city,
       coalesce(attacktype1_txt, 'Other') AS attacktype1_txt, coalesce(nkill, '0') AS nkill FROM raw""")
def b16(s, d):
    return clean.fill_defaults(
        T.raw_incidents(s, d), {"city": "Unknown", "attacktype1_txt": "Other", "nkill": "0", "absent": 0}
    )


@query("b17_drop_missing_coordinates", "eventid long, latitude double, longitude double",
       f"WITH {Q.INC}, {LOCATED} inc) SELECT * FROM located WHERE latitude IS NOT NULL AND longitude IS NOT NULL")
def b17(s, d):
    return T.incidents(s, d, casualties=False).transform(clean.validate_coordinates).transform(
        clean.drop_missing_coordinates
    )


@query("b18_mode_impute", "eventid long, attacktype1_txt string",
       f"""WITH {Q.RAW}, best AS (SELECT attacktype1_txt AS v FROM raw WHERE attacktype1_txt IS NOT NULL
       GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
       SELECT eventid, coalesce(attacktype1_txt, (SELECT v FROM best)) AS attacktype1_txt FROM raw""")
def b18(s, d):
    return clean.impute_mode(T.raw_incidents(s, d).select("eventid", "attacktype1_txt"), ["attacktype1_txt"])


@query("b19_drop_any_null", "eventid long, city string, gname string",
       f"""WITH {Q.RAW} SELECT eventid, city, gname FROM raw
       WHERE city IS NOT NULL AND gname IS NOT NULL AND iyear IS NOT NULL""")
def b19(s, d):
    return clean.drop_any_null(T.raw_incidents(s, d).select("eventid", "iyear", "city", "gname"))


@query("b20_feature_fill", "region_txt string, week_start date, attack_count_lag_52 long, attack_count_rolling_std_4 r6",
       f"""WITH {Q.full_panel()} SELECT series AS region_txt, week_start,
       coalesce(attack_count_lag_52, 0) AS attack_count_lag_52,
       coalesce(attack_count_rolling_std_4, 0) AS attack_count_rolling_std_4 FROM full_panel""")
def b20(s, d):
    return clean.fill_feature_nulls(panel.dense_weekly(T.featured_incidents(s, d), "region_txt"))


@query("b21_drop_columns", "eventid long, country_txt string", f"WITH {Q.INC} SELECT eventid, country_txt FROM inc")
def b21(s, d):
    return clean.drop_columns(T.incidents(s, d, casualties=False).select("eventid", "country_txt", "city"), "city", "absent")


@query("b22_select_features", """total_casualties double, total_killed double, total_wounded double, year int,
week int, month int, quarter int, day_of_year int, attack_count_lag_52 long, attack_count_rolling_mean_4 r6,
attack_count_rolling_std_4 r6, attack_count_rolling_mean_12 r6, attack_count_rolling_std_12 r6, attack_count long""",
       f"WITH {Q.full_panel()} SELECT * FROM full_panel")
def b22(s, d):
    return clean.select_features(panel.dense_weekly(T.featured_incidents(s, d), "region_txt"), "attack_count")


@query("b23_recent_span", "eventid long, date date",
       f"WITH {Q.INC} SELECT eventid, date FROM inc WHERE date >= (SELECT max(date) FROM inc) - INTERVAL 5 YEAR")
def b23(s, d):
    return clean.recent_span(T.incidents(s, d, casualties=False), "date")


# --- lookups --------------------------------------------------------------------------------

CODES = """codes AS (SELECT n_name AS country_txt,
  CASE WHEN n_nationkey % 5 <> 4 THEN 'C' || CAST(n_nationkey AS VARCHAR) END AS country_code,
  n_nationkey + 1 AS own_day FROM nation)"""
US_HOLIDAY = """((month(date) = 1 AND day(date) = 1) OR (month(date) = 7 AND day(date) = 4)
  OR (month(date) = 12 AND day(date) = 25)
  OR (month(date) = 5 AND isodow(date) = 1 AND day(date) >= 25)
  OR (month(date) = 9 AND isodow(date) = 1 AND day(date) <= 7)
  OR (month(date) = 11 AND isodow(date) = 4 AND day(date) BETWEEN 22 AND 28))"""


@query("j1_country_code", "eventid long, country_txt string, country_code string",
       f"WITH {Q.INC}, {CODES} SELECT * FROM inc LEFT JOIN codes USING (country_txt)")
def j1(s, d):
    return attach(T.incidents(s, d, casualties=False),
                  T.country_codes(s, d).select("country_txt", "country_code"), "country_txt")


@query("j2_country_holidays", "eventid long, country_code string, is_holiday int",
       f"""WITH {Q.INC}, {CODES} SELECT eventid, country_code,
       CASE WHEN country_code IS NOT NULL AND ({US_HOLIDAY} OR (month(date) = 3 AND day(date) = own_day))
            THEN 1 ELSE 0 END AS is_holiday
       FROM inc LEFT JOIN codes USING (country_txt)""")
def j2(s, d):
    return evaluate.attach_holidays(
        T.incidents(s, d, casualties=False),
        T.country_codes(s, d).select("country_txt", "country_code"), T.holiday_calendar(s, d),
    )


@query("j3_group_statistic", "eventid long, country_txt string, country_max double, country_events long",
       f"""WITH {Q.FEAT} SELECT eventid, country_txt, max(casualties) OVER (PARTITION BY country_txt) AS country_max,
       count(*) OVER (PARTITION BY country_txt) AS country_events FROM feat""")
def j3(s, d):
    return windows.group_statistics(T.featured_incidents(s, d), "country_txt", {
        "country_max": F.max("casualties"), "country_events": F.count(F.lit(1)),
    })


@query("j4_calendar_grid", "country_txt string, week_start date",
       f"WITH {Q.weekly('country_txt')} SELECT series AS country_txt, week_start FROM grid")
def j4(s, d):
    weekly = panel.aggregate_weekly(T.featured_incidents(s, d), "country_txt")
    return panel.calendar_grid(weekly.select("country_txt", "week_start"), "week_start", "country_txt", "week")


PREDICTED = """CASE WHEN eventid % 3 = 0 THEN attacktype1_txt WHEN eventid % 3 = 1 THEN '5-LOW'
  ELSE '1-URGENT' END"""


def predicted_type():
    turn = F.col("eventid") % 3
    return F.when(turn == 0, F.col("attacktype1_txt")).when(turn == 1, "5-LOW").otherwise("1-URGENT")


@query("j5_attach_predictions", "eventid long, latitude double, attacktype1_txt string, predicted_label string",
       f"WITH {Q.INC} SELECT eventid, latitude, attacktype1_txt, {PREDICTED} AS predicted_label FROM inc")
def j5(s, d):
    events = T.incidents(s, d, casualties=False)
    predictions = events.select("eventid", predicted_type().alias("predicted_label"))
    return evaluate.attach_predictions(events, predictions, "eventid")


# --- calendar -------------------------------------------------------------------------------

@query("c1_casualties", "eventid long, casualties double", f"WITH {Q.FEAT} SELECT eventid, casualties FROM feat")
def c1(s, d):
    return T.featured_incidents(s, d)


@query("c2_temporal", """eventid long, day_of_week int, day_name string, month int, month_name string, quarter int,
year int, day_of_year int, week_of_year int, is_weekend int""",
       f"""WITH {Q.INC} SELECT eventid, isodow(date) - 1 AS day_of_week, dayname(date) AS day_name, month(date) AS month,
       monthname(date) AS month_name, quarter(date) AS quarter, year(date) AS year, dayofyear(date) AS day_of_year,
       weekofyear(date) AS week_of_year, CASE WHEN isodow(date) >= 6 THEN 1 ELSE 0 END AS is_weekend FROM inc""")
def c2(s, d):
    return T.incidents(s, d, casualties=False).withColumns(C.temporal_features(F.col("date")))


@query("c3_us_holiday", "eventid long, date date, is_us_holiday int",
       f"WITH {Q.INC} SELECT eventid, date, CASE WHEN {US_HOLIDAY} THEN 1 ELSE 0 END AS is_us_holiday FROM inc")
def c3(s, d):
    return T.incidents(s, d, casualties=False).withColumn("is_us_holiday", C.us_holiday(F.col("date")))


@query("c4_cyclic", "eventid long, month_sin r6, month_cos r6, day_sin r6, day_cos r6",
       f"""WITH {Q.INC} SELECT eventid, sin((month(date) - 1) * (2 * pi() / 12)) AS month_sin,
       cos((month(date) - 1) * (2 * pi() / 12)) AS month_cos, sin((day(date) - 1) * (2 * pi() / 30)) AS day_sin,
       cos((day(date) - 1) * (2 * pi() / 30)) AS day_cos FROM inc""")
def c4(s, d):
    return T.incidents(s, d, casualties=False).withColumns(
        C.cyclic_features(F.month("date"), F.dayofmonth("date"))
    )


@query("c5_panel_time", "region_txt string, week_start date, year int, week int, month int, quarter int, day_of_year int",
       f"""WITH {Q.weekly()} SELECT series AS region_txt, week_start, year(week_start) AS year, weekofyear(week_start) AS week,
       month(week_start) AS month, quarter(week_start) AS quarter, dayofyear(week_start) AS day_of_year FROM wk""")
def c5(s, d):
    weekly = panel.aggregate_weekly(T.featured_incidents(s, d), "region_txt")
    return panel.add_time_features(weekly, "week_start")


@query("c6_integer_parts", "eventid long, Year int, Month int, Day int",
       f"""WITH {PADDED} SELECT eventid, CAST("Year" AS INTEGER) AS "Year", CAST("Month" AS INTEGER) AS "Month",
       CAST("Day" AS INTEGER) AS "Day" FROM padded""")
def c6(s, d):
    padded = clean.padded_date(_text_parts(s, d))
    return padded.withColumns(C.date_parts_as_int({c: F.col(c) for c in ("Year", "Month", "Day")}))


@query("c7_date_text", "eventid long, date_text string",
       f"WITH {Q.INC} SELECT eventid, strftime(date, '%Y-%m-%d') AS date_text FROM inc")
def c7(s, d):
    return T.incidents(s, d, casualties=False).withColumn("date_text", C.date_text(F.col("date")))


