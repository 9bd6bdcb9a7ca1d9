"""Forecaster, regressor and ablation queries over the weekly panel, split inside each series."""

from __future__ import annotations

from pyspark.ml.regression import LinearRegressionModel
from pyspark.sql import functions as F

from eventcast import schema as S
from eventcast.catalog import sqltext as Q
from eventcast.catalog.registry import query
from eventcast.catalog.sequences import dense
from eventcast.operators import ablate, evaluate, panel, regress, split
from eventcast.operators import forecast as G
from eventcast.session import new_path, result_table, stage
from eventcast.sources import files
from eventcast.sources import tables as T

ROLES = G.Series("region_txt", "week_start", "attack_count")
FORECAST = "model string, region_txt string, week_start date, step int, actual double, predicted r6"


def split_panel(s, d):
    return stage(split.series_split(
        dense(s, d).select("region_txt", "week_start", "attack_count"), "region_txt", "week_start"
    ))


BASE = Q.weekly() + Q.SERIES_SPLIT
NAIVE = """naive AS (
  SELECT 'Seasonal Naive' AS model, t.series, t.week_start, t.step, t.y AS actual,
    CASE WHEN t.step < 52 THEN coalesce(h.y, z.mean_train) ELSE z.mean_train END AS predicted
  FROM test t JOIN sizes z ON z.series = t.series
  LEFT JOIN train h ON h.series = t.series AND h.rn = z.n_train - 52 + t.step + 1)"""


def _moving(windows: tuple[int, ...]) -> str:
    sizes = " UNION ALL ".join(f"SELECT {w} AS w" for w in windows)
    return f"""history AS (SELECT series, list(y ORDER BY week_start) AS h FROM train GROUP BY 1),
steps AS (SELECT series, max(step) + 1 AS h FROM test GROUP BY 1),
ma(series, w, step, tail, p, horizon) AS (
  SELECT history.series, w, -1, list_slice(history.h, -w, -1), CAST(NULL AS DOUBLE), steps.h
  FROM history JOIN steps USING (series), ({sizes})
  UNION ALL
  SELECT series, w, step + 1, list_slice(list_append(tail, list_avg(tail)), -w, -1), list_avg(tail), horizon
  FROM ma WHERE step + 1 < horizon),
moving AS (
  SELECT 'Moving Average (window=' || w || ')' AS model, t.series, t.week_start, t.step, t.y AS actual, m.p AS predicted
  FROM ma m JOIN test t ON t.series = m.series AND t.step = m.step)"""


def _fit(tag: str, source: str, xs: list[str]) -> str:
    """CTEs ending in ``fit_<tag>`` (series, b0, b): least squares of y on ``xs`` by successive orthogonalisation."""
    n = len(xs)
    centred = ", ".join(f"{c} - avg({c}) OVER (PARTITION BY series) AS {o}" for c, o in [("y", "yc"), *((x, f"x{i}c") for i, x in enumerate(xs, 1))])
    first = f"{xs[0]} - avg({xs[0]}) OVER (PARTITION BY series) AS z1"
    parts = [f"m1_{tag} AS (SELECT series, y, {', '.join(xs)}, {centred}, {first} FROM {source})"]
    for i in range(2, n + 1):
        coefs = ", ".join(
            f"sum(x{i}c * z{j}) OVER (PARTITION BY series) / sum(z{j} * z{j}) OVER (PARTITION BY series) AS r{i}_{j}"
            for j in range(1, i))
        minus = " - ".join([f"x{i}c"] + [f"r{i}_{j} * z{j}" for j in range(1, i)])
        parts.append(f"m{i}_{tag} AS (SELECT *, {minus} AS z{i} FROM (SELECT *, {coefs} FROM m{i - 1}_{tag}))")
    kept = ", ".join(
        [f"sum(yc * z{i}) / sum(z{i} * z{i}) AS c{i}" for i in range(1, n + 1)]
        + [f"any_value(r{i}_{j}) AS r{i}_{j}" for i in range(2, n + 1) for j in range(1, i)]
        + ["avg(y) AS my", "count(*) AS n"] + [f"avg({x}) AS mx{i}" for i, x in enumerate(xs, 1)])
    parts.append(f"g_{tag} AS (SELECT series, {kept} FROM m{n}_{tag} GROUP BY 1)")
    source = f"g_{tag}"
    for i in range(n, 0, -1):
        minus = " - ".join([f"c{i}"] + [f"r{j}_{i} * b{j}" for j in range(i + 1, n + 1)])
        parts.append(f"b{i}_{tag} AS (SELECT *, {minus} AS b{i} FROM {source})")
        source = f"b{i}_{tag}"
    slopes = ", ".join(f"b{i}" for i in range(1, n + 1))
    parts.append(f"fit_{tag} AS (SELECT series, n, my - " + " - ".join(f"b{i} * mx{i}" for i in range(1, n + 1))
                 + f" AS b0, [{slopes}] AS b FROM {source})")
    return ", ".join(parts)


def _regression(n: int) -> str:
    """Least squares on n lags, then the recursive forecast."""
    lags = [f"x{k}" for k in range(1, n + 1)]
    lagged = ", ".join(
        f"lag(y, {k}) OVER (PARTITION BY series ORDER BY week_start) AS x{k}" for k in range(1, n + 1)
    )
    parts = [f"m0_{n} AS (SELECT * FROM (SELECT series, week_start, y, {lagged} FROM train) WHERE x{n} IS NOT NULL)",
             _fit(str(n), f"m0_{n}", lags)]
    parts.append(f"""hist_{n} AS (SELECT series, list_slice(list(y ORDER BY week_start DESC), 1, {n}) AS r FROM train GROUP BY 1),
hor_{n} AS (SELECT series, max(step) + 1 AS h FROM test GROUP BY 1),
rec_{n}(series, step, r, p, b0, b, h) AS (
  SELECT series, -1, r, CAST(NULL AS DOUBLE), b0, b, h FROM hist_{n} JOIN fit_{n} USING (series) JOIN hor_{n} USING (series)
  UNION ALL
  SELECT series, step + 1, list_slice(list_prepend(b0 + list_inner_product(b, r), r), 1, {n}),
    b0 + list_inner_product(b, r), b0, b, h FROM rec_{n} WHERE step + 1 < h),
linear_{n} AS (
  SELECT 'Linear Regression (lags={n})' AS model, t.series, t.week_start, t.step, t.y AS actual, f.p AS predicted
  FROM rec_{n} f JOIN test t ON t.series = f.series AND t.step = f.step)""")
    return ", ".join(parts)


@query("g1_seasonal_naive", FORECAST, f"WITH {BASE}, {NAIVE} SELECT *, series AS region_txt FROM naive")
def g1(s, d):
    return G.forecast_seasonal_naive(G.history_table(split_panel(s, d), ROLES), ROLES)


@query("g2_moving_average", FORECAST,
       f"WITH RECURSIVE {BASE}, {_moving((4,))} SELECT *, series AS region_txt FROM moving")
def g2(s, d):
    return G.forecast_moving_average(G.history_table(split_panel(s, d), ROLES), ROLES)


@query("g3_window_sweep", "model string, n long, RMSE r6, MAE r6, R2 r6",
       f"WITH RECURSIVE {BASE}, {_moving((4, 8, 12))} SELECT * FROM ({Q.metrics('moving', 'model')})")
def g3(s, d):
    histories = G.history_table(split_panel(s, d), ROLES)
    return evaluate.score(G.forecast_moving_average(histories, ROLES, [4, 8, 12]), by=["model"])


COEFS = "region_txt string, b0 r6, " + ", ".join(f"b{k} r6" for k in range(1, 5))


@query("g4_lagged_fit", COEFS,
       f"WITH RECURSIVE {BASE}, {_regression(4)} SELECT series AS region_txt, b0, "
       + ", ".join(f"b[{k}] AS b{k}" for k in range(1, 5)) + " FROM fit_4")
def g4(s, d):
    fitted = G.fit_lagged_regression(split_panel(s, d), ROLES, 4)
    return fitted.select("region_txt", *[F.get("coefficients", F.lit(k)).alias(f"b{k}") for k in range(5)])


@query("g5_lagged_forecast", FORECAST,
       f"WITH RECURSIVE {BASE}, {_regression(4)} SELECT *, series AS region_txt FROM linear_4")
def g5(s, d):
    rows = split_panel(s, d)
    return G.forecast_lagged_regression(rows, G.history_table(rows, ROLES), ROLES)


@query("g6_lag_sweep", "model string, n long, RMSE r6, MAE r6, R2 r6",
       f"WITH RECURSIVE {BASE}, {_regression(4)}, {_regression(8)}, {_regression(12)}, every AS ("
       + " UNION ALL ".join(f"SELECT * FROM linear_{n}" for n in (4, 8, 12))
       + f") SELECT * FROM ({Q.metrics('every', 'model')})")
def g6(s, d):
    rows = split_panel(s, d)
    histories = G.history_table(rows, ROLES)
    return evaluate.score(G.forecast_lagged_regression(rows, histories, ROLES, [4, 8, 12]), by=["model"])


def _arma(season: int | None, model: str) -> str:
    """CTEs ending in ``arma``: two least-squares stages, the fallback, and the recursive forecast."""
    lags = [1] if season is None else [1, season, season + 1]
    reach, long = max(lags), max(lags) + 2
    change = "y - lag(y, 1) OVER o"
    if season is not None:
        change += f" - lag(y, {season}) OVER o + lag(y, {season + 1}) OVER o"
    earlier = ", ".join(f"lag(w, {k}) OVER o AS l{k}" for k in range(1, long + 1))
    both = ", ".join(f"lag(w, {k}) OVER o AS w{k}, lag(e, {k}) OVER o AS e{k}" for k in lags)
    xs = [*(f"w{k}" for k in lags), *(f"e{k}" for k in lags)]
    window = "WINDOW o AS (PARTITION BY series ORDER BY week_start)"
    # The autoregressive part is stable if no reflection coefficient of the step-down recursion reaches 1.
    dense = "[" + ", ".join(f"b[{lags.index(k) + 1}]" if k in lags else "0.0" for k in range(1, reach + 1)) + "]"
    down = ("list_reduce(list_prepend({p}, list_transform(range({r}), lambda k: CAST([] AS DOUBLE[]))), lambda a, k: "
            "CASE WHEN len(a) = 0 THEN a WHEN abs(a[len(a)]) >= 1 THEN [9.0::DOUBLE] WHEN len(a) = 1 THEN [] "
            "ELSE list_transform(range(1, len(a)), lambda i: (a[i] + a[len(a)] * a[len(a) - i]) / (1 - a[len(a)] * a[len(a)])) END)"
            ).format(p=dense, r=reach + 1)
    terms = " + ".join([f"b[{i + 1}] * w[{k}]" for i, k in enumerate(lags)] + [f"b[{i + 1 + len(lags)}] * e[{k}]" for i, k in enumerate(lags)])
    undone = "v[1]" if season is None else f"v[1] + v[{season}] - v[{season + 1}]"
    return f"""
changed AS (SELECT * FROM (SELECT series, week_start, {change} AS w FROM train {window}) WHERE w IS NOT NULL),
longs AS (SELECT * FROM (SELECT series, week_start, w AS y, {earlier} FROM changed {window}) WHERE l{long} IS NOT NULL),
{_fit("long", "longs", [f"l{k}" for k in range(1, long + 1)])},
rest AS (SELECT series, week_start, y AS w, y - (b0 + list_inner_product(b, [{", ".join(f"l{k}" for k in range(1, long + 1))}])) AS e
  FROM longs JOIN fit_long USING (series)),
shorts AS (SELECT * FROM (SELECT series, week_start, w AS y, {both} FROM rest {window}) WHERE w{reach} IS NOT NULL),
{_fit("arma", "shorts", xs)},
single AS (SELECT * FROM (SELECT series, y, lag(y, 1) OVER o AS x1 FROM train {window}) WHERE x1 IS NOT NULL),
{_fit("ar1", "single", ["x1"])},
newest AS (SELECT series, list(y ORDER BY week_start DESC)[1:{reach}] AS v FROM train GROUP BY 1),
tails AS (SELECT series, list(w ORDER BY week_start DESC)[1:{reach}] AS w, list(e ORDER BY week_start DESC)[1:{reach}] AS e FROM rest GROUP BY 1),
ends AS (SELECT series, max(step) + 1 AS h FROM test GROUP BY 1),
starts AS (SELECT series, v, w, e, f.b0, f.b, a.b0 AS a0, a.b[1] AS a1, h,
    f.n > {len(xs) + 1} AND len({down.replace("b[", "f.b[")}) = 0 AS usable
  FROM newest JOIN tails USING (series) JOIN fit_arma f USING (series) JOIN fit_ar1 a USING (series) JOIN ends USING (series)),
walk(series, step, v, w, e, x, p, b0, b, a0, a1, h, usable) AS (
  SELECT series, -1, v, w, e, v[1], CAST(NULL AS DOUBLE), b0, b, a0, a1, h, usable FROM starts
  UNION ALL
  SELECT series, step + 1, list_prepend(nw + {undone}, v)[1:{reach}], list_prepend(nw, w)[1:{reach}], list_prepend(0.0, e)[1:{reach}],
    a0 + a1 * x, CASE WHEN usable THEN nw + {undone} ELSE a0 + a1 * x END, b0, b, a0, a1, h, usable
  FROM (SELECT *, b0 + {terms} AS nw FROM walk WHERE step + 1 < h)),
arma AS (SELECT '{model}' AS model, t.series, t.week_start, t.step, t.y AS actual, k.p AS predicted
  FROM walk k JOIN test t ON t.series = k.series AND t.step = k.step)"""


# Long recursions: compared to three digits.
STEPPED = "model string, region_txt string, week_start date, step int, actual double, predicted double"
ROUNDED = "SELECT model, series AS region_txt, week_start, step, actual, round(predicted, 3) + 0.0 AS predicted FROM arma"


@query("g7_arima", STEPPED, f"WITH RECURSIVE {BASE}, {_arma(None, 'ARIMA')} {ROUNDED}")
def g7(s, d):
    rows = split_panel(s, d)
    return G.forecast_arma(rows, G.history_table(rows, ROLES), ROLES, None).withColumn("predicted", F.round("predicted", 3))


@query("g7_sarima", STEPPED, f"WITH RECURSIVE {BASE}, {_arma(12, 'SARIMA')} {ROUNDED}")
def g7_seasonal(s, d):
    rows = split_panel(s, d)
    return G.forecast_arma(rows, G.history_table(rows, ROLES), ROLES, 12).withColumn("predicted", F.round("predicted", 3))


EVERY = "every AS (SELECT * FROM naive UNION ALL SELECT * FROM moving UNION ALL SELECT * FROM linear_4 UNION ALL SELECT * FROM arma)"


@query("g8_all_baselines", "model string, n long, RMSE r6, MAE r6, R2 r6",
       f"""WITH RECURSIVE {BASE}, {NAIVE}, {_moving((4,))}, {_regression(4)}, {_arma(12, 'SARIMA')}, {EVERY}
       SELECT * FROM ({Q.metrics('every', 'model')})""")
def g8(s, d):
    return G.run_all_baselines(split_panel(s, d), ROLES)


@query("g8_closed_form_baselines", "model string, n long, RMSE r6, MAE r6, R2 r6",
       f"""WITH RECURSIVE {BASE}, {NAIVE}, {_moving((4,))}, {_regression(4)},
       every AS (SELECT * FROM naive UNION ALL SELECT * FROM moving UNION ALL SELECT * FROM linear_4)
       SELECT * FROM ({Q.metrics('every', 'model')})""")
def g8_checked(s, d):
    return G.run_all_baselines(split_panel(s, d), ROLES).filter(F.col("model") != "SARIMA")


# Forecasts that run through the validation rows, so that test rows meet the forecasts for their own dates.
GAP_BASE = BASE.replace("FROM splitted WHERE split = 'test'", "FROM splitted WHERE split <> 'train'")
ALIGNED = """aligned AS (SELECT e.* REPLACE (CAST(row_number() OVER (PARTITION BY model, series ORDER BY week_start) - 1 AS INTEGER) AS step)
  FROM every e JOIN splitted s USING (series, week_start) WHERE s.split = 'test')"""


@query("g1_aligned_naive", FORECAST,
       f"WITH {GAP_BASE}, {NAIVE}, every AS (SELECT * FROM naive), {ALIGNED} SELECT *, series AS region_txt FROM aligned")
def g1_aligned(s, d):
    return G.forecast_seasonal_naive(G.history_table(split_panel(s, d), ROLES, gap=True), ROLES)


@query("g5_aligned_forecast", FORECAST,
       f"WITH RECURSIVE {GAP_BASE}, {_regression(4)}, every AS (SELECT * FROM linear_4), {ALIGNED} SELECT *, series AS region_txt FROM aligned")
def g5_aligned(s, d):
    rows = split_panel(s, d)
    return G.forecast_lagged_regression(rows, G.history_table(rows, ROLES, gap=True), ROLES)


@query("g8_aligned_baselines", "model string, n long, RMSE r6, MAE r6, R2 r6",
       f"""WITH RECURSIVE {GAP_BASE}, {NAIVE}, {_moving((4,))}, {_regression(4)}, {_arma(12, 'SARIMA')}, {EVERY}, {ALIGNED}
       SELECT * FROM ({Q.metrics('aligned', 'model')})""")
def g8_aligned(s, d):
    return G.run_all_baselines(split_panel(s, d), ROLES, gap=True)


# --- learned models and ablations -----------------------------------------------------------

def full_panel(s, d):
    return stage(panel.dense_weekly(T.featured_incidents(s, d), "region_txt"))


RESULT = "model string, n long, RMSE r6, MAE r6, MSE r6, R2 r6"


@query("g9_sequence_regressor", "region_txt string, target_date date, y double, predicted double")
def g9(s, d):
    from eventcast.operators.sequences import to_vectors

    windows, _, _ = regress.model_windows(full_panel(s, d), "region_txt", "week_start")
    vectors = to_vectors(windows)
    return regress.predict(regress.train_regressor(vectors, regress.Regressor("linear")), vectors)


@query("g10_learned_model", RESULT)
def g10(s, d):
    return regress.learned_model(full_panel(s, d), "region_txt", "week_start")[0]


GROUPED = {  # feature columns of the panel by group
    "Casualty Features": ["total_casualties", "total_killed", "total_wounded"],
    "Lag Features": ["attack_count_lag_52"],
    "Rolling Statistics": [f"attack_count_rolling_{k}_{n}" for n in (4, 12) for k in ("mean", "std")],
}


@query("h4_feature_groups", "group_name string, column_name string, present long, mean r6",
       f"WITH {Q.full_panel()} " + " UNION ALL ".join(
           f"SELECT '{g}' AS group_name, '{c}' AS column_name, count({c}) AS present, avg({c}) AS mean FROM full_panel"
           for g, members in GROUPED.items() for c in members)
       + " UNION ALL SELECT 'Geographic Features', 'region_txt', count(series), NULL FROM full_panel")
def h4(s, d):
    """The groups of the panel's columns, with the values that each column has."""
    rows = full_panel(s, d)
    groups = ablate.feature_groups(rows.columns)
    named = result_table(
        s, [(g, c) for g, members in groups.items() for c in members], "group_name string, column_name string"
    )
    columns = [c for members in groups.values() for c in members]
    held = rows.agg(*[F.struct(F.count(c).alias("present"), F.avg(F.col(c).try_cast("double")).alias("mean")).alias(c) for c in columns])
    return named.join(held.unpivot([], columns, "column_name", "_v").select("column_name", "_v.*"), "column_name")


@query("h5_feature_ablation", """Feature_Group string, Features_Count int, RMSE r6, MAE r6, R2 r6, RMSE_Impact r6,
MAE_Impact r6, Interpretation string""")
def h5(s, d):
    return ablate.feature_ablation(full_panel(s, d), "region_txt", "week_start")


DATA = """Configuration string, Samples long, Sequences long, RMSE r6, MAE r6, R2 r6, RMSE_Impact r6,
Interpretation string"""


@query("h7_span_ablation", DATA)
def h7(s, d):
    return ablate.span_ablation(full_panel(s, d), "region_txt", "week_start", report_skipped=True)


@query("h8_length_ablation", DATA)
def h8(s, d):
    return ablate.length_ablation(full_panel(s, d), "region_txt", "week_start")


@query("h9_setting_sweep", """Architecture string, Model_Type string, Settings string, RMSE r6, MAE r6, R2 r6,
Description string""")
def h9(s, d):
    return ablate.setting_sweep(full_panel(s, d), "region_txt", "week_start")


# --- the same fits without penalty on short windows, which SQL can express -------------------

PLAIN = regress.Regressor("plain", "linear", {"regParam": 0.0})
FEW = ["total_killed", "attack_count_rolling_mean_4"]


def few_columns(s, d):
    return full_panel(s, d).select("region_txt", "week_start", "attack_count", *FEW)


def _windowed(tag: str, features: list[str], length: int, source: str = "full_panel",
              ratios: tuple[float, float] = S.SPLIT_RATIOS[:2]) -> str:
    """CTEs ``win_<tag>`` (all windows) and ``pred_<tag>`` (region, target_date, actual, predicted) of the test rows.

    A fit with an intercept and without penalty predicts the same from scaled features.
    """
    xs = [f"a{j}_{i}" for j in range(length, 0, -1) for i in range(len(features))]
    lagged = ", ".join(f"CAST(lag({f}, {j}) OVER o AS DOUBLE) AS a{j}_{i}" for j in range(length, 0, -1) for i, f in enumerate(features))
    train = f"floor(n * CAST({ratios[0]} AS DOUBLE))"
    return f"""win_{tag} AS (SELECT *, row_number() OVER (ORDER BY target_date, region) - 1 AS pos, count(*) OVER () AS n FROM (
  SELECT 'all' AS series, series AS region, week_start AS target_date, CAST(attack_count AS DOUBLE) AS y, {lagged} FROM {source}
  WINDOW o AS (PARTITION BY series ORDER BY week_start)) WHERE a{length}_0 IS NOT NULL),
train_{tag} AS (SELECT * FROM win_{tag} WHERE pos < {train}),
{_fit(tag, f"train_{tag}", xs)},
pred_{tag} AS (SELECT region, target_date, y AS actual, b0 + list_inner_product(b, [{", ".join(xs)}]) AS predicted
  FROM win_{tag} w, fit_{tag} WHERE pos >= {train} + floor(w.n * CAST({ratios[1]} AS DOUBLE)))""".replace(
        f"pos >= {train}", f"pos >= {train.replace('n *', 'w.n *')}")


PREDICTED_ROWS = "region_txt string, target_date date, y double, predicted r6"
G9_SQL = (f"WITH {Q.full_panel()}, {_windowed('few', FEW, 2)} "
          "SELECT region AS region_txt, target_date, actual AS y, predicted FROM pred_few")


def _few_vectors(s, d):
    from eventcast.operators.sequences import to_vectors

    return to_vectors(regress.model_windows(few_columns(s, d), "region_txt", "week_start", length=2)[0])


@query("g9_plain_regressor", PREDICTED_ROWS, G9_SQL)
def g9_plain(s, d):
    vectors = _few_vectors(s, d)
    return regress.predict(regress.train_regressor(vectors, PLAIN), vectors)


@query("a10_plain_model_store", PREDICTED_ROWS, G9_SQL)
def a10_plain(s, d):
    path, vectors = new_path(s, "model"), _few_vectors(s, d)
    files.save_model(regress.train_regressor(vectors, PLAIN), path)
    return regress.predict(files.load_model(LinearRegressionModel, path), vectors)


@query("g10_plain_model", RESULT,
       f"WITH {Q.full_panel()}, {_windowed('few', FEW, 2)} SELECT 'plain' AS model, * FROM ({Q.metrics('pred_few')})")
def g10_plain(s, d):
    return regress.learned_model(few_columns(s, d), "region_txt", "week_start", PLAIN, length=2)[0]


def _ablated() -> str:
    kept = {ablate.BASELINE: FEW, "Casualty Features": FEW[1:], "Rolling Statistics": FEW[:1]}
    parts = [_windowed(f"g{i}", features, 2, ratios=ablate.TWO_WAY) for i, features in enumerate(kept.values())]
    rows = " UNION ALL ".join(f"""SELECT '{group}' AS "Feature_Group", {len(features)} AS "Features_Count", * FROM ({Q.metrics(f'pred_g{i}')})"""
                              for i, (group, features) in enumerate(kept.items()))
    levels = " ".join(f"WHEN abs(r.\"RMSE\" - b.\"RMSE\") > {least} THEN '{meaning}'" for least, meaning in evaluate.IMPACT_LEVELS)
    return f"""WITH {Q.full_panel()}, {", ".join(parts)}, scored AS ({rows})
      SELECT r.*, r."RMSE" - b."RMSE" AS "RMSE_Impact", r."MAE" - b."MAE" AS "MAE_Impact",
        CASE WHEN r."Feature_Group" = b."Feature_Group" THEN 'Baseline' {levels} ELSE '{evaluate.LOWEST_IMPACT}' END AS "Interpretation"
      FROM scored r, (SELECT * FROM scored WHERE "Feature_Group" = '{ablate.BASELINE}') b"""


@query("h5_plain_ablation", """Feature_Group string, Features_Count int, RMSE r6, MAE r6, R2 r6, RMSE_Impact r6,
MAE_Impact r6, Interpretation string""", _ablated())
def h5_plain(s, d):
    return ablate.feature_ablation(few_columns(s, d), "region_txt", "week_start", length=2, regressor=PLAIN)


def _data_rows(rows: dict[str, tuple[str, int]], base: str, other: str) -> str:
    """``rows``: name -> (source relation, window length)."""
    parts = [_windowed(f"d{i}", FEW, n, source, ablate.TWO_WAY) for i, (source, n) in enumerate(rows.values())]
    scored = " UNION ALL ".join(f"""SELECT '{name}' AS "Configuration", (SELECT count(*) FROM {source}) AS "Samples",
      (SELECT count(*) FROM win_d{i}) AS "Sequences", * FROM ({Q.metrics(f'pred_d{i}')})""" for i, (name, (source, _)) in enumerate(rows.items()))
    return f"""WITH {Q.full_panel()}, latest AS (SELECT max(week_start) AS w FROM full_panel),
      recent AS (SELECT p.* FROM full_panel p, latest WHERE week_start >= w - INTERVAL 24 MONTH), {", ".join(parts)}, scored AS ({scored})
      SELECT r.*, r."RMSE" - b."RMSE" AS "RMSE_Impact", CASE WHEN r."Configuration" = '{base}' THEN 'Baseline' {other} END AS "Interpretation"
      FROM scored r, (SELECT * FROM scored WHERE "Configuration" = '{base}') b"""


@query("h7_plain_spans", DATA, _data_rows(
    {"Full History": ("full_panel", 2), "Recent Only (Last 2 Years)": ("recent", 2)}, "Full History",
    """WHEN r."RMSE" - b."RMSE" < 0 THEN 'Recent patterns' ELSE 'Long history needed'"""))
def h7_plain(s, d):
    return ablate.span_ablation(few_columns(s, d), "region_txt", "week_start", length=2, months=24, regressor=PLAIN)


@query("h8_plain_lengths", DATA, _data_rows(
    {f"Sequence Length {n}": ("full_panel", n) for n in (1, 2, 4)}, "Sequence Length 2", "ELSE ''"))
def h8_plain(s, d):
    return ablate.length_ablation(few_columns(s, d), "region_txt", "week_start", lengths=(1, 2, 4), baseline=2, regressor=PLAIN)


@query("h9_plain_setting", """Architecture string, Model_Type string, Settings string, RMSE r6, MAE r6, R2 r6,
Description string""",
       f"""WITH {Q.full_panel()}, {_windowed('few', FEW, 2)} SELECT 'linear-plain' AS "Architecture", 'linear' AS "Model_Type",
       '{{''regParam'': 0.0}}' AS "Settings", *, 'penalty 0' AS "Description" FROM ({Q.metrics('pred_few')})""")
def h9_plain(s, d):
    return ablate.setting_sweep(few_columns(s, d), "region_txt", "week_start", length=2, settings=[ablate.SETTINGS[3]])
