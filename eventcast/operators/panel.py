"""Aggregation to day, week or month grain and densification."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventcast import schema as S
from eventcast.functions import calendar as C
from eventcast.operators.windows import rolling_statistics, seasonal_lag
from eventcast.session import stage

TIME_COLUMN = {"day": "date", "week": "week_start", "month": "month_start"}


def _measures() -> list[Column]:
    return [
        F.count("eventid").alias("attack_count"),
        F.sum("casualties").alias("total_casualties"),
        F.sum("nkill").alias("total_killed"),
        F.sum("nwound").alias("total_wounded"),
    ]


def aggregate_daily(events: DataFrame, grain: str) -> DataFrame:
    return events.groupBy("date", grain).agg(*_measures())


def aggregate_weekly(events: DataFrame, grain: str) -> DataFrame:
    """Per Monday week and series: the measures, the earliest date, year and ISO week."""
    weekly = events.groupBy(C.period_start(F.col("date"), "week").alias("week_start"), grain).agg(
        *_measures(), F.min("date").alias("first_attack_date")
    )
    return weekly.withColumns({"year": F.year("week_start"), "week": F.weekofyear("week_start")})


def aggregate_monthly(events: DataFrame, grain: str) -> DataFrame:
    monthly = events.groupBy(
        C.period_start(F.col("date"), "month").alias("month_start"), grain
    ).agg(*_measures())
    return monthly.withColumns({"year": F.year("month_start"), "month": F.month("month_start")})


def monthly_from_daily(daily: DataFrame, grain: str) -> DataFrame:
    """Monthly panel rolled up from the daily one (all measures are additive)."""
    monthly = daily.groupBy(C.period_start(F.col("date"), "month").alias("month_start"), grain).agg(
        *[F.sum(m).alias(m) for m in S.PANEL_MEASURES]
    )
    return monthly.withColumns({"year": F.year("month_start"), "month": F.month("month_start")})


def weekly_from_daily(daily: DataFrame, grain: str) -> DataFrame:
    weekly = daily.groupBy(C.period_start(F.col("date"), "week").alias("week_start"), grain).agg(
        *[F.sum(m).alias(m) for m in S.PANEL_MEASURES], F.min("date").alias("first_attack_date")
    )
    return weekly.withColumns({"year": F.year("week_start"), "week": F.weekofyear("week_start")})


def calendar_grid(panel: DataFrame, time: str, by: str, unit: str) -> DataFrame:
    """Every series on every period between the earliest and the latest one of the table."""
    edges = panel.agg(F.struct(F.min(time).alias("lo"), F.max(time).alias("hi"))).scalar()
    periods = C.period_range(edges.getField("lo"), edges.getField("hi"), unit)
    return panel.select(by).distinct().withColumn(time, F.explode(periods))


def fill_missing_periods(
    panel: DataFrame, time: str, by: str, unit: str, measures: Sequence[str] = S.PANEL_MEASURES
) -> DataFrame:
    """Dense panel: absent cells get 0 measures; other columns stay null there.

    The aggregated panel is staged because it is read three times (series, edges, cells) and
    is small next to the events it came from.
    """
    panel = stage(panel)
    grid = calendar_grid(panel, time, by, unit)
    names = [m for m in measures if m in panel.columns]
    return grid.join(panel, [by, time], "left").fillna(0, subset=names)


def add_time_features(panel: DataFrame, time: str) -> DataFrame:
    return panel.withColumns(C.panel_time_features(F.col(time)))


def dense_weekly(
    events: DataFrame, grain: str, target: str = "attack_count", period: int = S.SEASONAL_LAG,
    windows: Sequence[int] = (4, 12), weekly: DataFrame | None = None,
) -> DataFrame:
    """Weekly counts, gaps filled, calendar parts, seasonal lag and rolling statistics."""
    weekly = aggregate_weekly(events, grain) if weekly is None else weekly
    dense = fill_missing_periods(weekly.drop("year", "week"), "week_start", grain, "week")
    return (
        dense.transform(add_time_features, "week_start")
        .transform(seasonal_lag, target, period, by=grain, time="week_start")
        .transform(rolling_statistics, target, windows, by=grain, time="week_start")
    )


def aggregate_data(events: DataFrame, grain: str = "region") -> dict[str, DataFrame]:
    """Daily, monthly and dense weekly tables; events are read once, the rest is rolled up."""
    column = S.grain_column(grain)
    daily = stage(aggregate_daily(events, column))
    return {
        "daily": daily,
        "weekly": dense_weekly(events, column, weekly=weekly_from_daily(daily, column)),
        "monthly": monthly_from_daily(daily, column),
    }


def resample(events: DataFrame, columns: Sequence[str], unit: str, count_name: str) -> DataFrame:
    """Sums and row count of the whole table per period end (Sunday or month end).

    Empty periods stay as 0 rows. Output has one row per period, whatever the input size.
    """
    start = events.select(C.period_start(F.col("date"), unit).alias("_start"), *columns)
    sums = stage(start.groupBy("_start").agg(
        *[F.sum(c).alias(c) for c in columns], F.count(F.lit(1)).alias(count_name)
    ))
    edges = sums.agg(F.min("_start").alias("lo"), F.max("_start").alias("hi"))
    grid = edges.select(F.explode(C.period_range(F.col("lo"), F.col("hi"), unit)).alias("_start"))
    end = C.week_end(F.col("_start")) if unit == "week" else F.last_day("_start")
    return (
        grid.join(sums, "_start", "left").fillna(0, subset=[*columns, count_name])
        .select(end.alias("period_end"), *columns, count_name)
    )
