"""Per-series forecasters.

Every series contributes one row with its training history and test dates as arrays (at most one
value per period, so bounded by the calendar), and a forecaster is a column expression over that
row. Least-squares fits come from distributed sums of products; only the tiny per-series solve
runs in Python, one Arrow batch of series at a time.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from eventcast.operators import evaluate
from eventcast.operators.windows import lag_matrix

COEFFICIENTS = T.ArrayType(T.DoubleType())

# The solver functions travel with the plan, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass(frozen=True)
class Series:
    """Column roles of a panel with a ``split`` column."""

    by: str
    time: str
    target: str


def history_table(panel: DataFrame, roles: Series, gap: bool = False) -> DataFrame:
    """One row per series: ``history`` (train), ``actual`` and ``dates`` (test), in time order, and ``skipped``.

    Without ``gap`` the first forecast after the train rows is held against the first test row, whatever lies between
    them. With ``gap`` the forecasts run through the periods in between, ``skipped`` of them, so that every test row is
    held against the forecast for its own date.
    """
    point = F.struct(F.col(roles.time).alias("t"), F.col(roles.target).cast("double").alias("v"))

    def ordered(split: str) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col("split") == split, point)))

    return panel.groupBy(roles.by).agg(
        ordered("train").alias("_train"), ordered("test").alias("_test"),
        F.count_if(F.col("split") == "val").cast("int").alias("_between"),
    ).select(
        roles.by,
        (F.col("_between") if gap else F.lit(0)).alias("skipped"),
        F.col("_train.v").alias("history"),
        F.col("_test.t").alias("dates"),
        F.col("_test.v").alias("actual"),
    )


def unfold(forecasts: DataFrame, by: str, time: str, forecast: Column, model: str) -> DataFrame:
    """Long form: one row per test step with the actual and the predicted value."""
    forecast = F.slice(forecast, F.col("skipped") + 1, F.size("actual"))
    rows = F.arrays_zip(
        F.col("dates").alias("t"), F.col("actual").alias("a"), forecast.alias("p")
    )
    return (
        forecasts.select(by, F.posexplode(rows).alias("step", "_r"))
        .select(
            F.lit(model).alias("model"), by, F.col("_r.t").alias(time), "step",
            F.col("_r.a").alias("actual"), F.col("_r.p").alias("predicted"),
        )
    )


def _horizon() -> Column:
    """Periods from the last train row to the last test row, as far as they are forecast."""
    return F.col("skipped") + F.size("actual")


def _steps(horizon: Column) -> Column:
    return F.when(horizon > 0, F.sequence(F.lit(1), horizon)).otherwise(
        F.array().cast("array<int>")
    )


def _tail(values: Column, n: int) -> Column:
    return F.slice(values, F.greatest(F.lit(1), F.size(values) - n + 1), n)


def _mean(values: Column) -> Column:
    return F.try_divide(F.aggregate(values, F.lit(0.0), lambda a, v: a + v), F.size(values))


# --- seasonal naive and moving average ------------------------------------------------------

def seasonal_naive(history: Column, horizon: Column, period: int = 52) -> Column:
    """Step i repeats the value one season back while that lies in the history, else its mean."""
    n = F.size(history)
    return F.transform(
        _steps(horizon),
        lambda i: F.coalesce(
            F.when((n - period + i >= 1) & (i <= period), F.get(history, n - period + i - 1)),
            _mean(history),
        ),
    )


def moving_average(history: Column, horizon: Column, window: int = 4) -> Column:
    """Mean of the last ``window`` values; each prediction joins the history of the next."""
    start = F.struct(
        _tail(history, window).alias("tail"), F.array().cast("array<double>").alias("out")
    )

    def step(state: Column, _: Column) -> Column:
        nxt = F.array(_mean(state["tail"]))
        return F.struct(
            _tail(F.concat(state["tail"], nxt), window).alias("tail"),
            F.concat(state["out"], nxt).alias("out"),
        )

    return F.aggregate(_steps(horizon), start, step, lambda s: s["out"])


def forecast_seasonal_naive(histories: DataFrame, roles: Series, period: int = 52) -> DataFrame:
    return unfold(histories, roles.by, roles.time,
                  seasonal_naive(F.col("history"), _horizon(), period), "Seasonal Naive")


def forecast_moving_average(
    histories: DataFrame, roles: Series, windows: Sequence[int] = (4,)
) -> DataFrame:
    """One or several windows; the sweep is a union over the same small history table."""
    parts = [
        unfold(histories, roles.by, roles.time,
               moving_average(F.col("history"), _horizon(), w),
               f"Moving Average (window={w})")
        for w in windows
    ]
    return reduce(DataFrame.unionByName, parts)


# --- least squares from centred moments ----------------------------------------------------

def product_sums(rows: DataFrame, by: Sequence[str], y: str, xs: Sequence[str]) -> DataFrame:
    """Per group: n, means, and the moments around them of the regressors and with y, as arrays."""
    x = [F.col(c).cast("double") for c in xs]
    target = F.col(y).cast("double")
    aggregates = [
        F.count(F.lit(1)).cast("double").alias("n"),
        F.avg(target).alias("mean_y"),
        F.array(*[F.avg(a) for a in x]).alias("mean_x"),
        F.array(*[
            F.covar_pop(x[i], x[j]) for i in range(len(x)) for j in range(i, len(x))
        ]).alias("moment_xx"),
        F.array(*[F.covar_pop(a, target) for a in x]).alias("moment_xy"),
    ]
    return rows.groupBy(*by).agg(*aggregates) if by else rows.agg(*aggregates)


def _normal_solution(n, mean_y, mean_x, moment_xx, moment_xy):
    k = len(mean_x)
    upper = np.zeros((k, k))
    upper[np.triu_indices(k)] = moment_xx
    full = upper + np.triu(upper, 1).T
    slopes, _, rank, _ = np.linalg.lstsq(full, np.asarray(moment_xy), rcond=1e-10)
    return np.concatenate([[mean_y - np.asarray(mean_x) @ slopes], slopes]), rank


@F.pandas_udf(COEFFICIENTS)
def solve_least_squares(
    n: pd.Series, mean_y: pd.Series, mean_x: pd.Series, moment_xx: pd.Series, moment_xy: pd.Series
) -> pd.Series:
    """[intercept, slopes...] per row; the smallest solution when the system is singular."""
    return pd.Series([
        _normal_solution(*row)[0].tolist() for row in zip(n, mean_y, mean_x, moment_xx, moment_xy)
    ])


def _stable(coefficients: np.ndarray, lags: Sequence[int]) -> bool:
    order = max(lags)
    companion = np.eye(order, k=-1)
    for c, lag in zip(coefficients, lags):
        companion[0, lag - 1] = c
    return bool(np.max(np.abs(np.linalg.eigvals(companion))) < 1.0)


def solve_stable(lags: Sequence[int]):
    """Solver giving null for singular systems and for non-stationary autoregressive parts.

    The first ``len(lags)`` regressors are the values at those lags.
    """
    lags = tuple(lags)

    @F.pandas_udf(COEFFICIENTS)
    def solve(
        n: pd.Series, mean_y: pd.Series, mean_x: pd.Series, moment_xx: pd.Series, moment_xy: pd.Series
    ) -> pd.Series:
        found = []
        for row in zip(n, mean_y, mean_x, moment_xx, moment_xy):
            beta, rank = _normal_solution(*row)
            usable = rank == len(row[2]) and row[0] > len(row[2]) + 1
            usable = usable and np.all(np.isfinite(beta))
            usable = usable and _stable(beta[1:1 + len(lags)], lags)
            found.append(beta.tolist() if usable else None)
        return pd.Series(found, dtype=object)

    return solve


SUMS = ["n", "mean_y", "mean_x", "moment_xx", "moment_xy"]


def fit_lagged_regression(
    panel: DataFrame, roles: Series, n_lags: int = 4, pooled: bool = False
) -> DataFrame:
    """Ordinary least squares of the target on its lags over the train rows.

    ``coefficients`` is [intercept, lag_1, ..., lag_n], one row per series or one in all.
    """
    train = panel.filter(F.col("split") == "train")
    rows = lag_matrix(train, roles.target, n_lags, by=roles.by, time=roles.time)
    by = [] if pooled else [roles.by]
    sums = product_sums(rows, by, "y", [f"lag_{k}" for k in range(1, n_lags + 1)])
    # An aggregate over no rows has nothing to solve.
    return sums.filter(F.col("n") > 0).select(
        *by, solve_least_squares(*SUMS).alias("coefficients")
    )


def lagged_regression(
    history: Column, horizon: Column, coefficients: Column, n_lags: int
) -> Column:
    """Recursive forecast; coefficient k always meets the k-th newest value."""
    start = F.struct(
        F.reverse(_tail(history, n_lags)).alias("recent"),
        F.array().cast("array<double>").alias("out"),
    )
    slopes = F.slice(coefficients, 2, n_lags)

    def step(state: Column, _: Column) -> Column:
        terms = F.zip_with(slopes, state["recent"], lambda b, v: b * v)
        nxt = F.aggregate(terms, F.get(coefficients, F.lit(0)), lambda a, v: a + v)
        return F.struct(
            F.slice(F.concat(F.array(nxt), state["recent"]), 1, n_lags).alias("recent"),
            F.concat(state["out"], F.array(nxt)).alias("out"),
        )

    return F.when(
        F.size(history) >= n_lags, F.aggregate(_steps(horizon), start, step, lambda s: s["out"])
    )


def forecast_lagged_regression(
    panel: DataFrame, histories: DataFrame, roles: Series, lags: Sequence[int] = (4,),
    pooled: bool = False,
) -> DataFrame:
    parts = []
    for n in lags:
        fitted = fit_lagged_regression(panel, roles, n, pooled)
        if pooled:
            rows = histories.withColumn("coefficients", fitted.scalar())
        else:
            rows = histories.join(fitted, roles.by)
        forecast = lagged_regression(
            F.col("history"), _horizon(), F.col("coefficients"), n
        )
        parts.append(unfold(rows, roles.by, roles.time, forecast, f"Linear Regression (lags={n})"))
    return reduce(DataFrame.unionByName, parts)


# --- differenced autoregression with moving-average terms -----------------------------------

def fit_arma(
    panel: DataFrame, roles: Series, season: int | None = 12, long_lags: int | None = None
) -> DataFrame:
    """Two-stage least squares (Hannan and Rissanen, 1982) on the differenced train series.

    A long autoregression gives residuals; the differenced value is then regressed on its own
    lags and on residual lags. ``season=None`` is order (1,1,1); with a season s both parts also
    use lags s and s+1. Output per series: ``arma`` (null when unusable), ``ar1`` (fallback on the
    undifferenced series) and the newest-first ``w`` and ``e`` the forecast starts from.
    """
    lags = [1] if season is None else [1, season, season + 1]
    reach = max(lags)
    long_lags = long_lags or reach + 2
    ordered = Window.partitionBy(roles.by).orderBy(roles.time)
    train = panel.filter(F.col("split") == "train").select(
        roles.by, roles.time, F.col(roles.target).cast("double").alias("v")
    )
    change = F.col("v") - F.lag("v", 1).over(ordered)
    if season is not None:
        change = change - F.lag("v", season).over(ordered) + F.lag("v", season + 1).over(ordered)
    differenced = train.withColumn("w", change).filter(F.col("w").isNotNull())

    first = lag_matrix(differenced, "w", long_lags, by=roles.by, time=roles.time)
    names = [f"lag_{k}" for k in range(1, long_lags + 1)]
    long_fit = product_sums(first, [roles.by], "y", names).select(
        roles.by, solve_least_squares(*SUMS).alias("long")
    )
    fitted = F.get("long", F.lit(0)) + sum(
        F.get("long", F.lit(k)) * F.col(f"lag_{k}") for k in range(1, long_lags + 1)
    )
    residuals = first.join(long_fit, roles.by).select(
        roles.by, roles.time, F.col("y").alias("w"), (F.col("y") - fitted).alias("e")
    )

    w_names, e_names = [f"w_{k}" for k in lags], [f"e_{k}" for k in lags]
    second = residuals.select(
        "*",
        *[F.lag("w", k).over(ordered).alias(f"w_{k}") for k in lags],
        *[F.lag("e", k).over(ordered).alias(f"e_{k}") for k in lags],
    )
    usable = second.dropna(subset=[*w_names, *e_names])
    arma = product_sums(usable, [roles.by], "w", [*w_names, *e_names]).select(
        roles.by, solve_stable(lags)(*SUMS).alias("arma")
    )
    # ``reach`` newest points per series: a fixed, small number of values.
    recent = residuals.withColumn(
        "_back", F.row_number().over(Window.partitionBy(roles.by).orderBy(F.desc(roles.time)))
    ).filter(F.col("_back") <= reach)
    points = F.array_sort(F.collect_list(F.struct("_back", "w", "e")))
    tails = recent.groupBy(roles.by).agg(points.alias("_p")).select(
        roles.by, F.col("_p.w").alias("w"), F.col("_p.e").alias("e")
    )
    single = lag_matrix(train, "v", 1, by=roles.by, time=roles.time)
    ar1 = product_sums(single, [roles.by], "y", ["lag_1"]).select(
        roles.by, solve_least_squares(*SUMS).alias("ar1")
    )
    return ar1.join(arma, roles.by, "left").join(tails, roles.by, "left")


def arma_forecast(history: Column, horizon: Column, fit: dict[str, Column], season: int | None) -> Column:
    """Fold one step at a time: future residuals are 0, then the differencing is undone."""
    lags = [1] if season is None else [1, season, season + 1]
    reach = max(lags)
    beta = fit["arma"]
    start = F.struct(
        F.reverse(_tail(history, reach)).alias("v"), fit["w"].alias("w"), fit["e"].alias("e"),
        F.array().cast("array<double>").alias("out"),
    )

    def back(values: Column, lag: int) -> Column:
        return F.get(values, F.lit(lag - 1))

    def step(state: Column, _: Column) -> Column:
        w = F.get(beta, F.lit(0))
        for i, lag in enumerate(lags):
            w = w + F.get(beta, F.lit(1 + i)) * back(state["w"], lag)
            w = w + F.get(beta, F.lit(1 + len(lags) + i)) * back(state["e"], lag)
        v = w + back(state["v"], 1)
        if season is not None:
            v = v + back(state["v"], season) - back(state["v"], season + 1)

        def push(value: Column, name: str) -> Column:
            return F.slice(F.concat(F.array(value), state[name]), 1, reach).alias(name)

        return F.struct(
            push(v, "v"), push(w, "w"), push(F.lit(0.0), "e"),
            F.concat(state["out"], F.array(v)).alias("out"),
        )

    folded = F.aggregate(_steps(horizon), start, step, lambda s: s["out"])
    enough = (
        beta.isNotNull() & (F.size(history) >= reach)
        & (F.coalesce(F.size(fit["w"]), F.lit(0)) >= reach)
    )
    return F.when(enough, folded).otherwise(lagged_regression(history, horizon, fit["ar1"], 1))


def forecast_arma(
    panel: DataFrame, histories: DataFrame, roles: Series, season: int | None = 12
) -> DataFrame:
    fitted = fit_arma(panel, roles, season)
    rows = histories.join(fitted, roles.by)
    forecast = arma_forecast(
        F.col("history"), _horizon(), {c: F.col(c) for c in ("arma", "ar1", "w", "e")}, season
    )
    return unfold(rows, roles.by, roles.time, forecast, "ARIMA" if season is None else "SARIMA")


# --- all baselines --------------------------------------------------------------------------

def all_forecasts(panel: DataFrame, roles: Series, period: int = 52, gap: bool = False) -> DataFrame:
    """Forecasts of the four baselines over the same split panel, long form."""
    histories = history_table(panel, roles, gap)
    parts = [
        forecast_seasonal_naive(histories, roles, period),
        forecast_moving_average(histories, roles),
        forecast_arma(panel, histories, roles, min(period, 12)),
        forecast_lagged_regression(panel, histories, roles),
    ]
    return reduce(DataFrame.unionByName, parts)


def run_all_baselines(panel: DataFrame, roles: Series, period: int = 52, gap: bool = False) -> DataFrame:
    """model, RMSE, MAE, MSE, R2 sorted by RMSE; a model without forecasts is left out."""
    scored = evaluate.score(
        all_forecasts(panel, roles, period, gap).filter(F.col("predicted").isNotNull()),
        "actual", "predicted", ["model"],
    )
    return evaluate.rank_by_rmse(scored)
