"""Forecasters against NumPy written from the textbook definitions."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventcast.operators import evaluate, forecast as G
from eventcast.operators.split import series_split

ROLES = G.Series("g", "t", "y")


def waves(n=200, seed=0):
    t = np.arange(n)
    noise = np.random.default_rng(seed).normal(0, 2, n)
    return 10 * np.sin(2 * np.pi * t / 52) + 0.1 * t + noise + 50


def panel(spark, series):
    start = datetime.date(2001, 1, 1)
    rows = [(g, start + datetime.timedelta(weeks=i), float(v)) for g, values in series.items() for i, v in enumerate(values)]
    return series_split(spark.createDataFrame(rows, "g string, t date, y double"), "g", "t")


def parts(values):
    n = len(values)
    return values[:int(n * 0.7)], values[int(n * (0.7 + 0.15)):]


def predicted(forecasts, g="a"):
    return [r["predicted"] for r in forecasts.filter(F.col("g") == g).orderBy("step").collect()]


def test_seasonal_naive(spark):
    values = waves()
    rows = panel(spark, {"a": values, "short": values[:30]})
    train, test = parts(values)
    found = G.forecast_seasonal_naive(G.history_table(rows, ROLES), ROLES, 12)
    expected = [train[len(train) - 12 + i] if i < 12 else train.mean() for i in range(len(test))]
    assert predicted(found) == pytest.approx(expected)
    short = G.forecast_seasonal_naive(G.history_table(rows, ROLES), ROLES, 52)
    assert predicted(short, "short") == pytest.approx([values[:21].mean()] * 5)


@pytest.mark.parametrize("window", [1, 4, 300])
def test_moving_average(spark, window):
    values = waves()
    train, test = parts(values)
    history, expected = list(train), []
    for _ in test:
        history.append(np.mean(history[-window:]))
        expected.append(history[-1])
    found = G.forecast_moving_average(G.history_table(panel(spark, {"a": values}), ROLES), ROLES, [window])
    assert predicted(found) == pytest.approx(expected)


def least_squares(y, columns):
    beta, *_ = np.linalg.lstsq(np.column_stack([np.ones(len(y)), *columns]), y, rcond=None)
    return beta


@pytest.mark.parametrize("n", [1, 4, 12])
def test_lagged_regression(spark, n):
    values = waves()
    train, test = parts(values)
    beta = least_squares(train[n:], [train[n - k:-k] for k in range(1, n + 1)])
    history, expected = list(train), []
    for _ in test:
        history.append(beta[0] + sum(beta[k] * history[-k] for k in range(1, n + 1)))
        expected.append(history[-1])
    rows = panel(spark, {"a": values, "b": waves(seed=1)})
    found = G.forecast_lagged_regression(rows, G.history_table(rows, ROLES), ROLES, [n])
    assert predicted(found) == pytest.approx(expected, rel=1e-6)


def test_pooled_fit_uses_every_series(spark):
    rows = panel(spark, {"a": waves(), "b": waves(seed=1)})
    y, x = [], []
    for seed in (0, 1):
        train, _ = parts(waves(seed=seed))
        y.append(train[1:]), x.append(train[:-1])
    expected = least_squares(np.concatenate(y), [np.concatenate(x)])
    found = G.fit_lagged_regression(rows, ROLES, 1, pooled=True).first()["coefficients"]
    assert found == pytest.approx(list(expected), rel=1e-6)


def arma_in_numpy(train, horizon, season):
    lags = [1] if season is None else [1, season, season + 1]
    reach, long = max(lags), max(lags) + 2
    w = np.diff(train)
    if season is not None:
        w = w[season:] - w[:-season]
    beta = least_squares(w[long:], [w[long - k:-k] for k in range(1, long + 1)])
    e = w[long:] - (beta[0] + sum(beta[k] * w[long - k:-k] for k in range(1, long + 1)))
    w = w[long:]
    gamma = least_squares(w[reach:], [w[reach - k:-k] for k in lags] + [e[reach - k:-k] for k in lags])
    w, e, v, out = list(w), list(e), list(train), []
    for _ in range(horizon):
        nxt = gamma[0] + sum(gamma[1 + i] * w[-k] + gamma[1 + len(lags) + i] * e[-k] for i, k in enumerate(lags))
        value = nxt + v[-1] + (v[-season] - v[-season - 1] if season is not None else 0)
        w.append(nxt), e.append(0.0), v.append(value), out.append(value)
    return out


@pytest.mark.parametrize("season", [None, 12])
def test_differenced_arma(spark, season):
    values = waves(300)
    train, test = parts(values)
    rows = panel(spark, {"a": values})
    assert G.fit_arma(rows, ROLES, season).first()["arma"] is not None
    found = G.forecast_arma(rows, G.history_table(rows, ROLES), ROLES, season)
    assert predicted(found) == pytest.approx(arma_in_numpy(train, len(test), season), rel=1e-5)


def test_arma_falls_back_on_short_and_constant_series(spark):
    rows = panel(spark, {"a": waves(20), "c": np.full(200, 7.0)})
    found = G.forecast_arma(rows, G.history_table(rows, ROLES), ROLES, 12)
    assert all(v is not None for v in predicted(found))
    assert predicted(found, "c") == pytest.approx([7.0] * 30)


def test_all_baselines_are_ranked(spark):
    results = G.run_all_baselines(panel(spark, {"a": waves(300), "b": waves(300, 3)}), ROLES).collect()
    assert len(results) == 4
    assert [r["RMSE"] for r in results] == sorted(r["RMSE"] for r in results)
    assert {r["n"] for r in results} == {90}


def test_series_without_train_or_test_rows(spark):
    rows = panel(spark, {"one": [3.0], "a": waves(60)})
    assert G.all_forecasts(rows, ROLES).filter("g = 'a'").count() == 4 * 9
    assert G.all_forecasts(rows, ROLES).filter("g = 'one' and predicted is not null").count() == 0


def test_score_of_constant_actuals(spark):
    rows = spark.createDataFrame(
        [("exact", 2.0, 2.0), ("exact", 2.0, 2.0), ("off", 2.0, 3.0), ("off", 2.0, 1.0), ("one", 1.0, 4.0)],
        "m string, actual double, predicted double",
    )
    found = {r["m"]: r for r in evaluate.score(rows, by=["m"]).collect()}
    assert found["exact"]["R2"] == 1.0 and found["off"]["R2"] == 0.0 and found["one"]["R2"] == 0.0
    assert found["off"]["RMSE"] == 1.0 and found["one"]["MAE"] == 3.0
