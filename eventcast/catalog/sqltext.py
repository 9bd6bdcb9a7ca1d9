"""SQL text shared by the oracles: the incident view and what is derived from it."""

from __future__ import annotations

INC = """
cas AS (
  SELECT l_orderkey AS eventid,
         CAST(count(*) FILTER (WHERE l_returnflag = 'R') AS DOUBLE) AS nkill,
         CAST(count(*) FILTER (WHERE l_returnflag = 'A') AS DOUBLE) AS nwound
  FROM lineitem GROUP BY 1),
inc AS (
  SELECT o_orderkey AS eventid, CAST(o_orderdate AS DATE) AS date, r_name AS region_txt,
         n_name AS country_txt, c_name AS city, n_name || '/' || c_mktsegment AS provstate,
         o_orderpriority AS attacktype1_txt, c_mktsegment AS targtype1_txt,
         o_orderstatus AS weaptype1_txt, o_orderstatus || '-' || c_mktsegment AS gname,
         c_acctbal / 100 AS latitude, o_totalprice / 1000 - 200 AS longitude, nkill, nwound
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey LEFT JOIN cas ON eventid = o_orderkey)"""

FEAT = INC + """,
feat AS (
  SELECT * REPLACE (coalesce(nkill, 0) AS nkill, coalesce(nwound, 0) AS nwound),
         coalesce(nkill, 0) + coalesce(nwound, 0) AS casualties
  FROM inc)"""

RAW = INC + """,
raw AS (
  SELECT eventid,
    CASE WHEN eventid % 97 <> 0 THEN CAST(year(date) AS VARCHAR) END AS iyear,
    CASE WHEN eventid % 31 = 0 THEN '0' WHEN eventid % 37 = 0 THEN '2'
         ELSE CAST(month(date) AS VARCHAR) END AS imonth,
    CASE WHEN eventid % 29 = 0 THEN '0' WHEN eventid % 37 = 0 THEN '30'
         WHEN eventid % 89 = 0 THEN 'abc' ELSE CAST(day(date) AS VARCHAR) END AS iday,
    CASE WHEN eventid % 101 <> 0 THEN country_txt END AS country_txt,
    CASE WHEN eventid % 103 <> 0 THEN region_txt END AS region_txt,
    ' ' || provstate || '  ' AS provstate,
    CASE WHEN eventid % 11 = 0 THEN '   ' WHEN eventid % 13 = 0 THEN 'nan'
         WHEN eventid % 17 = 0 THEN NULL ELSE city END AS city,
    CASE WHEN eventid % 7 <> 0 THEN gname END AS gname,
    CASE WHEN eventid % 19 <> 0 THEN attacktype1_txt END AS attacktype1_txt,
    targtype1_txt,
    CASE WHEN eventid % 23 = 0 THEN '' ELSE weaptype1_txt END AS weaptype1_txt,
    CASE WHEN eventid % 41 = 0 THEN 'NaN' WHEN eventid % 43 = 0 THEN 'abc'
         ELSE CAST(latitude AS VARCHAR) END AS latitude,
    CASE WHEN eventid % 47 <> 0 THEN CAST(longitude AS VARCHAR) END AS longitude,
    CASE WHEN eventid % 83 = 0 THEN 'abc' WHEN eventid % 79 = 0 THEN 'NaN'
         ELSE CAST(nkill AS VARCHAR) END AS nkill,
    CAST(nwound AS VARCHAR) AS nwound
  FROM (SELECT * FROM inc UNION ALL SELECT * FROM inc WHERE eventid % 10 = 0))"""


def number(c: str) -> str:
    return f"CASE WHEN NOT isnan(TRY_CAST({c} AS DOUBLE)) THEN TRY_CAST({c} AS DOUBLE) END"


def whole(c: str) -> str:
    return f"CASE WHEN ({number(c)}) = floor(({number(c)})) THEN CAST(({number(c)}) AS INTEGER) END"


TYPED = RAW + f""",
typed AS (
  SELECT * REPLACE (
    {whole('iyear')} AS iyear, {whole('imonth')} AS imonth, {whole('iday')} AS iday,
    coalesce({number('nkill')}, 0) AS nkill, coalesce({number('nwound')}, 0) AS nwound,
    {number('latitude')} AS latitude, {number('longitude')} AS longitude)
  FROM raw)"""

DATED = TYPED + """,
dated AS (
  SELECT * FROM (
    SELECT * REPLACE (CASE WHEN imonth = 0 THEN 1 ELSE imonth END AS imonth,
                      CASE WHEN iday = 0 THEN 1 ELSE iday END AS iday),
      TRY_CAST(CAST(iyear AS VARCHAR)
        || '-' || lpad(CAST(CASE WHEN imonth = 0 THEN 1 ELSE imonth END AS VARCHAR), 2, '0')
        || '-' || lpad(CAST(CASE WHEN iday = 0 THEN 1 ELSE iday END AS VARCHAR), 2, '0') AS DATE)
        AS date
    FROM typed)
  WHERE date IS NOT NULL)"""


def tidy(c: str) -> str:
    return f"coalesce(nullif(nullif(trim({c}), ''), 'nan'), 'Unknown')"


def weekly(grain: str = "region_txt") -> str:
    """``wk``: observed weekly cells; ``grid``: every cell; ``panel``: the dense panel."""
    return FEAT + f""",
wk AS (
  SELECT CAST(date_trunc('week', date) AS DATE) AS week_start, {grain} AS series,
         count(*) AS attack_count, sum(casualties) AS total_casualties,
         sum(nkill) AS total_killed, sum(nwound) AS total_wounded, min(date) AS first_attack_date
  FROM feat GROUP BY 1, 2),
grid AS (
  SELECT series, CAST(w AS DATE) AS week_start
  FROM (SELECT DISTINCT series FROM wk),
       (SELECT unnest(generate_series(min(week_start), max(week_start), INTERVAL 7 DAY)) AS w FROM wk)),
panel AS (
  SELECT series, week_start, coalesce(attack_count, 0) AS attack_count,
         coalesce(total_casualties, 0) AS total_casualties, coalesce(total_killed, 0) AS total_killed,
         coalesce(total_wounded, 0) AS total_wounded, first_attack_date
  FROM grid LEFT JOIN wk USING (series, week_start))"""


def std(column: str, frame: str) -> str:
    return f"stddev_samp({column}) OVER {frame}"


def full_panel(grain: str = "region_txt") -> str:
    """``full``: the dense panel with calendar parts, seasonal lag and rolling statistics."""
    return weekly(grain) + f""",
f64 AS (SELECT *, CAST(attack_count AS DOUBLE) AS x FROM panel),
full_panel AS (
  SELECT *, year(week_start) AS year, weekofyear(week_start) AS week, month(week_start) AS month,
    quarter(week_start) AS quarter, dayofyear(week_start) AS day_of_year,
    lag(attack_count, 52) OVER (PARTITION BY series ORDER BY week_start) AS attack_count_lag_52,
    avg(x) OVER w4 AS attack_count_rolling_mean_4, {std('x', 'w4')} AS attack_count_rolling_std_4,
    avg(x) OVER w12 AS attack_count_rolling_mean_12, {std('x', 'w12')} AS attack_count_rolling_std_12
  FROM f64
  WINDOW w4 AS (PARTITION BY series ORDER BY week_start ROWS BETWEEN 3 PRECEDING AND CURRENT ROW),
         w12 AS (PARTITION BY series ORDER BY week_start ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))"""


PANEL_COLUMNS = """region_txt string, week_start date, attack_count long, total_casualties double,
total_killed double, total_wounded double, first_attack_date date, year int, week int, month int,
quarter int, day_of_year int, attack_count_lag_52 long, attack_count_rolling_mean_4 r6,
attack_count_rolling_std_4 r6, attack_count_rolling_mean_12 r6, attack_count_rolling_std_12 r6"""

# Panel split inside each series, with 0-based positions in the train part and the test part.
SERIES_SPLIT = """,
numbered AS (
  SELECT series, week_start, CAST(attack_count AS DOUBLE) AS y,
         row_number() OVER (PARTITION BY series ORDER BY week_start) AS rn,
         count(*) OVER (PARTITION BY series) AS n
  FROM panel),
splitted AS (
  SELECT *, CASE WHEN rn <= floor(n * CAST(0.7 AS DOUBLE)) THEN 'train'
                 WHEN rn <= floor(n * (CAST(0.7 AS DOUBLE) + CAST(0.15 AS DOUBLE))) THEN 'val'
                 ELSE 'test' END AS split
  FROM numbered),
train AS (SELECT * FROM splitted WHERE split = 'train'),
test AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY series ORDER BY week_start) - 1 AS INTEGER) AS step
  FROM splitted WHERE split = 'test'),
sizes AS (SELECT series, count(*) AS n_train, avg(y) AS mean_train, max(rn) AS last_train
          FROM train GROUP BY 1)"""


def metrics(source: str, by: str = "") -> str:
    """Select of n, RMSE, MAE, MSE, R2 from a relation with actual and predicted."""
    keys = f"{by}, " if by else ""
    group = f" GROUP BY {by}" if by else ""
    return f"""
SELECT {keys}n, sqrt(ss / n) AS "RMSE", sa / n AS "MAE", ss / n AS "MSE",
       CASE WHEN st <> 0 THEN 1 - ss / st WHEN ss = 0 THEN 1.0 ELSE 0.0 END AS "R2"
FROM (SELECT {keys}count(*) AS n, sum((actual - predicted) * (actual - predicted)) AS ss,
             sum(abs(actual - predicted)) AS sa, var_pop(actual) * count(*) AS st
      FROM {source}{group})"""
