"""Recency, frequency, group statistics, lags and rolling features.

Two kinds of input are kept apart. Event tables have groups of any size (one country may hold a
third of all events): there, work is pre-aggregated to days or cut into blocks of positions.
Panels have one row per period and series, so a series is bounded by the calendar and an
ordinary window is enough.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from eventcast.operators.attach import attach
from eventcast.operators.rank import global_rank, windowed_by_position
from eventcast.session import stage


# --- event tables ---------------------------------------------------------------------------

def day_gaps(days: DataFrame, group: str, date: str) -> DataFrame:
    """(group, date, _first) with the days since the group's previous day with events."""
    ordered = Window.partitionBy(group).orderBy(date)
    return days.withColumn("_gap", F.datediff(F.col(date), F.lag(date).over(ordered)))


def day_frequencies(days: DataFrame, windows: Sequence[int], group: str, date: str) -> DataFrame:
    """(group, date, _n) with the group's events in the N days before each day."""
    ordered = Window.partitionBy(group).orderBy(F.unix_date(F.col(date)))
    return days.withColumns({
        f"attacks_last_{n}d": F.coalesce(F.sum("_n").over(ordered.rangeBetween(-n, -1)), F.lit(0))
        for n in windows
    })


def _gap_of(event_id: str) -> Column:
    # Only the first event of a group's day has a gap; repeats on the same day are 0 apart.
    return F.coalesce(F.when(F.col(event_id) == F.col("_first"), F.col("_gap")), F.lit(0))


def days_since_last(
    events: DataFrame, group: str = "country_txt", date: str = "date", event_id: str = "eventid",
    out: str = "days_since_last",
) -> DataFrame:
    """Days since the previous event of the group; first event and same-day repeats give 0.

    The lag runs over (group, day), so a group's window holds at most one row per day.
    """
    days = events.groupBy(group, date).agg(F.min(event_id).alias("_first"))
    return (
        attach(events, day_gaps(days, group, date), [group, date])
        .withColumn(out, _gap_of(event_id))
        .drop("_first", "_gap")
    )


def event_frequency(
    events: DataFrame, windows: Sequence[int] = (7, 30, 90), group: str = "country_txt",
    date: str = "date",
) -> DataFrame:
    """Events of the group in the N days before the event's day."""
    days = events.groupBy(group, date).agg(F.count(F.lit(1)).alias("_n"))
    counts = day_frequencies(days, windows, group, date).drop("_n")
    return attach(events, counts, [group, date])


def history_features(
    events: DataFrame, windows: Sequence[int] = (7, 30, 90), country: str = "country_txt",
    region: str = "region_txt", kind: str = "attacktype1_txt", date: str = "date",
    event_id: str = "eventid", measure: str = "casualties",
) -> DataFrame:
    """Recency, frequency, region and type features from a single pass over the events.

    One small (country, region, type, day) table feeds every lookup, so the events are read once
    to build it and once to receive the features.
    """
    cells = stage(events.groupBy(country, region, kind, date).agg(
        F.count(F.lit(1)).alias("_n"), F.min(event_id).alias("_first"),
        F.sum(measure).alias("_sum"), F.count(measure).alias("_have"),
    ))
    days = cells.groupBy(country, date).agg(F.sum("_n").alias("_n"), F.min("_first").alias("_first"))
    days = day_frequencies(day_gaps(days, country, date), windows, country, date).drop("_n")
    mean = F.try_divide(F.sum("_sum"), F.sum("_have"))
    regions = cells.groupBy(region).agg(
        mean.alias("region_avg_casualties"), F.sum("_n").alias("region_attack_count")
    )
    kinds = cells.groupBy(kind).agg(mean.alias("attacktype_avg_casualties"))
    return (
        events.transform(attach, days, [country, date])
        .withColumn("days_since_last", _gap_of(event_id))
        .drop("_first", "_gap")
        .transform(attach, regions, region)
        .transform(attach, kinds, kind)
    )


def group_statistics(events: DataFrame, group: str, stats: dict[str, Column]) -> DataFrame:
    """Aggregate per group and repeat the result on each of its rows."""
    return attach(
        events, events.groupBy(group).agg(*[c.alias(name) for name, c in stats.items()]), group
    )


def region_features(events: DataFrame, measure: str = "casualties") -> DataFrame:
    return group_statistics(events, "region_txt", {
        "region_avg_casualties": F.avg(measure),
        "region_attack_count": F.count(F.lit(1)),
    })


def attack_type_features(events: DataFrame, measure: str = "casualties") -> DataFrame:
    return group_statistics(
        events, "attacktype1_txt", {"attacktype_avg_casualties": F.avg(measure)}
    )


def event_lags(
    events: DataFrame, target: str, lags: Sequence[int] = (1, 7, 30), *, order: Sequence[str],
    by: Sequence[str] = (), block: int = 100_000,
) -> DataFrame:
    """Row lags over the whole table (or per ``by``), whatever the group size."""
    def lag(k: int):
        return lambda w: F.lag(target, k).over(w)

    ranked = global_rank(events, order, by, out="_position")
    return windowed_by_position(
        ranked, "_position", by, max(lags), {f"{target}_lag_{k}": lag(k) for k in lags}, block
    ).drop("_position")


def event_rolling(
    events: DataFrame, targets: Sequence[str], window: int = 3, *, order: Sequence[str],
    by: Sequence[str] = (), block: int = 100_000,
) -> DataFrame:
    """Lag 1 and full-window rolling mean and sample std; null until the window is full."""
    def full(target: str, statistic):
        def build(w: WindowSpec) -> Column:
            frame = w.rowsBetween(-(window - 1), 0)
            return F.when(F.count(target).over(frame) == window, statistic(target, frame))
        return build

    columns = {}
    for t in targets:
        columns[f"{t}_lag1"] = lambda w, t=t: F.lag(t, 1).over(w)
        columns[f"{t}_rolling_mean"] = full(t, lambda c, f: F.avg(c).over(f))
        columns[f"{t}_rolling_std"] = full(t, rolling_std)
    ranked = global_rank(events, order, by, out="_position")
    return windowed_by_position(
        ranked, "_position", by, max(window - 1, 1), columns, block
    ).drop("_position")


# --- panels ---------------------------------------------------------------------------------

def rolling_std(column: str, frame: WindowSpec) -> Column:
    """Sample standard deviation from centred squares; null below two values."""
    return F.stddev_samp(F.col(column).cast("double")).over(frame)


def seasonal_lag(
    panel: DataFrame, target: str, period: int = 52, *, by: str, time: str
) -> DataFrame:
    ordered = Window.partitionBy(by).orderBy(time)
    return panel.withColumn(f"{target}_lag_{period}", F.lag(target, period).over(ordered))


def rolling_statistics(
    panel: DataFrame, target: str, windows: Sequence[int] = (4, 12), *, by: str, time: str
) -> DataFrame:
    """Trailing mean and sample std, current row included, from one row on."""
    ordered = Window.partitionBy(by).orderBy(time)
    columns = {}
    for w in windows:
        frame = ordered.rowsBetween(-(w - 1), 0)
        columns[f"{target}_rolling_mean_{w}"] = F.avg(target).over(frame)
        columns[f"{target}_rolling_std_{w}"] = rolling_std(target, frame)
    return panel.withColumns(columns)


def lag_matrix(
    panel: DataFrame, target: str, n_lags: int = 4, *, by: str, time: str
) -> DataFrame:
    """Target with lag_1..lag_n; warm-up rows are dropped."""
    ordered = Window.partitionBy(by).orderBy(time)
    names = [f"lag_{k}" for k in range(1, n_lags + 1)]
    lags = [F.lag(target, k).over(ordered).alias(f"lag_{k}") for k in range(1, n_lags + 1)]
    return panel.select(by, time, F.col(target).alias("y"), *lags).dropna(subset=["y", *names])
