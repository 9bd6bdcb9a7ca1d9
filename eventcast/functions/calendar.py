"""Calendar and holiday expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Truncation unit and step of each period.
PERIODS = {"day": ("day", "1 day"), "week": ("week", "7 days"), "month": ("month", "1 month")}


def period_start(date: Column, unit: str) -> Column:
    """First day of the day, Monday week or month holding ``date``."""
    return date if unit == "day" else F.trunc(date, PERIODS[unit][0])


def period_range(first: Column, last: Column, unit: str) -> Column:
    """Array of period starts from ``first`` to ``last``."""
    return F.sequence(first, last, F.expr(f"interval {PERIODS[unit][1]}"))


def week_end(date: Column) -> Column:
    """Sunday closing the Monday week."""
    return F.date_add(F.trunc(date, "week"), 6)


def temporal_features(date: Column) -> dict[str, Column]:
    """Calendar parts of an event date; Monday is day 0."""
    weekday = F.weekday(date)
    return {
        "day_of_week": weekday,
        "day_name": F.date_format(date, "EEEE"),
        "month": F.month(date),
        "month_name": F.date_format(date, "MMMM"),
        "quarter": F.quarter(date),
        "year": F.year(date),
        "day_of_year": F.dayofyear(date),
        "week_of_year": F.weekofyear(date),
        "is_weekend": F.when(weekday >= 5, 1).otherwise(0),
    }


def panel_time_features(date: Column) -> dict[str, Column]:
    return {
        "year": F.year(date),
        "week": F.weekofyear(date),
        "month": F.month(date),
        "quarter": F.quarter(date),
        "day_of_year": F.dayofyear(date),
    }


def us_holiday(date: Column) -> Column:
    """1 on six US public holidays, else 0."""
    month, day, weekday = F.month(date), F.dayofmonth(date), F.weekday(date)
    fixed = (
        ((month == 1) & (day == 1)) | ((month == 7) & (day == 4)) | ((month == 12) & (day == 25))
    )
    floating = (
        ((month == 5) & (weekday == 0) & (day >= 25))
        | ((month == 9) & (weekday == 0) & (day <= 7))
        | ((month == 11) & (weekday == 3) & day.between(22, 28))
    )
    return F.when(fixed | floating, 1).otherwise(0)


def cyclic_features(month: Column, day: Column) -> dict[str, Column]:
    month_angle = (month - 1) * F.lit(2 * math.pi / 12)
    day_angle = (day - 1) * F.lit(2 * math.pi / 30)
    return {
        "month_sin": F.sin(month_angle),
        "month_cos": F.cos(month_angle),
        "day_sin": F.sin(day_angle),
        "day_cos": F.cos(day_angle),
    }


def date_text(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM-dd")


def date_parts_as_int(parts: dict[str, Column]) -> dict[str, Column]:
    """Text date parts back to integers."""
    return {name: c.cast("int") for name, c in parts.items()}
