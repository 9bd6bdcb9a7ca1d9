"""Source and sink queries: each writes into the shared folder and returns what it reads back."""

from __future__ import annotations

from pyspark.ml.regression import LinearRegressionModel
from pyspark.sql import functions as F

from eventcast import schema as S
from eventcast.catalog import sqltext as Q
from eventcast.catalog.registry import query
from eventcast.catalog.reports import SCORES, _scores
from eventcast.catalog.sequences import CODES, ENCODED, _ranked, _whole, _windows_sql, dense, windows
from eventcast.operators import encode, regress, split
from eventcast.operators.windows import seasonal_lag
from eventcast.operators.sequences import to_vectors
from eventcast.session import new_path
from eventcast.sources import files
from eventcast.sources import tables as T


@query("a1_raw_csv_scan", """eventid long, iyear string, imonth string, iday string, country_txt string, city string,
gname string, weaptype1_txt string""",
       f"""WITH {Q.RAW} SELECT eventid, iyear, imonth, iday, country_txt, city, gname,
       nullif(weaptype1_txt, '') AS weaptype1_txt FROM raw""")
def a1(s, d):
    path = new_path(s, "raw")
    raw = T.raw_incidents(s, d).withColumn("summary", F.lit(None).cast("string"))
    files.write_csv(raw.select(*S.RAW_INCIDENT_SCHEMA.fieldNames()), path, "ISO-8859-1")
    return files.read_raw_csv(s, path, multi_line=False)  # no field here spans lines


@query("a1_csv_with_line_breaks", "eventid long, city string, summary string",
       f"""WITH {Q.RAW} SELECT eventid, city, country_txt || chr(10) || '"' || coalesce(gname, '') || '"' || chr(10) || ', é' || iyear AS summary
       FROM raw""")
def a1_breaks(s, d):
    path = new_path(s, "raw")
    free = F.concat("country_txt", F.lit('\n"'), F.coalesce("gname", F.lit("")), F.lit('"\n, é'), "iyear")
    raw = T.raw_incidents(s, d).withColumn("summary", free)
    files.write_csv(raw.select(*S.RAW_INCIDENT_SCHEMA.fieldNames()), path, "ISO-8859-1")
    return files.read_raw_csv(s, path)


@query("a2_stage_write", "region_txt string, date date, eventid long, casualties double",
       f"WITH {Q.FEAT} SELECT region_txt, date, eventid, casualties FROM feat")
def a2(s, d):
    path = new_path(s, "stage")
    files.write_stage(T.featured_incidents(s, d), path, ["region_txt"])
    return files.read_stage(s, path)


@query("a3_stage_read", "region_txt string, date date, eventid long", f"WITH {Q.FEAT} SELECT region_txt, date, eventid FROM feat")
def a3(s, d):
    path = new_path(s, "stage")
    files.write_stage(T.incidents(s, d, casualties=False), path, ["region_txt"])
    return files.read_stage(s, path).select("region_txt", "date", "eventid")


@query("a4_window_store", "region_txt string, target_date date, x string, y double, split string",
       f"""WITH {Q.weekly()}, {_windows_sql(30)}, {_ranked('samples', 'target_date, region_txt')}
       SELECT * FROM s""")
def a4(s, d):
    path = new_path(s, "windows")
    files.write_windows(split.chronological_split(windows(s, d), "target_date", ["region_txt"]), path)
    return files.read_stage(s, path).withColumn("x", _whole("x"))


@query("a5_predictions_sink", "actual double, predicted double",
       f"""WITH {Q.weekly()}, p AS (SELECT attack_count AS actual,
       lag(attack_count, 52) OVER (PARTITION BY series ORDER BY week_start) AS predicted FROM panel)
       SELECT * FROM p WHERE predicted IS NOT NULL""")
def a5(s, d):
    path = new_path(s, "predictions")
    lagged = seasonal_lag(dense(s, d), "attack_count", by="region_txt", time="week_start").dropna("any")
    files.write_predictions(lagged, path, "attack_count", "attack_count_lag_52")
    return s.read.csv(path, header=True, schema="actual double, predicted double")


@query("a6_metrics_sink", "model string, metric string, value r6",
       f"""WITH {SCORES} SELECT model, 'RMSE' AS metric, "RMSE" AS value FROM scores UNION ALL SELECT model, 'MAE', "MAE" FROM scores
       UNION ALL SELECT model, 'MSE', "MSE" FROM scores UNION ALL SELECT model, 'R2', "R2" FROM scores""")
def a6(s, d):
    path = new_path(s, "metrics")
    files.write_metrics(_scores(s, d), path)
    return s.read.json(path, schema="model string, metric string, value double")


@query("a7_results_sink", "model string, n long, RMSE r6, MAE r6, R2 r6", f"WITH {SCORES} SELECT * FROM scores")
def a7(s, d):
    path = new_path(s, "results")
    files.write_results(_scores(s, d).select("model", "n", "RMSE", "MAE", "R2"), path)
    return s.read.csv(path, header=True, schema="model string, n long, RMSE double, MAE double, R2 double")


@query("a8_encoder_store", "column_name string, value string, code int", f"WITH {Q.INC}, {CODES} SELECT * FROM codes")
def a8(s, d):
    path = new_path(s, "codes")
    files.write_stage(encode.fit_label_codes(T.incidents(s, d, casualties=False), ENCODED), path)
    return files.read_stage(s, path)


@query("a9_scaler_store", "feature string, min r6, max r6, mean r6, std_pop r6",
       f"WITH {Q.weekly()} " + " UNION ALL ".join(
           f"SELECT '{c}' AS feature, min({c}) AS min, max({c}) AS max, avg({c}) AS mean, stddev_pop({c}) AS std_pop FROM panel"
           for c in S.PANEL_MEASURES))
def a9(s, d):
    path = new_path(s, "scaler")
    files.write_stage(encode.fit_scaler(dense(s, d), S.PANEL_MEASURES), path)
    return files.read_stage(s, path)


@query("a10_model_store", "region_txt string, target_date date, y double, predicted double")
def a10(s, d):
    path = new_path(s, "model")
    rows, _, _ = regress.model_windows(dense(s, d), "region_txt", "week_start", length=12)
    vectors = to_vectors(rows)
    files.save_model(regress.train_regressor(vectors, regress.Regressor("linear")), path)
    return regress.predict(files.load_model(LinearRegressionModel, path), vectors)
