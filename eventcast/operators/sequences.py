"""Sliding windows over panels, one row per sample."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventcast import schema as S
from eventcast.operators.clean import drop_any_null
from eventcast.operators.windows import seasonal_lag


def create_sequences(
    panel: DataFrame, features: Sequence[str], target: str, length: int = S.SEQUENCE_LENGTH, *,
    by: str, time: str,
) -> DataFrame:
    """x = the ``length`` rows before a row of the same series, y = its target.

    A series of n rows gives n - length samples and none when n <= length. Completeness is
    tested on a count, not on ``x``, so plans that need only the keys never build ``x``.
    """
    frame = Window.partitionBy(by).orderBy(time).rowsBetween(-length, -1)
    step = F.array(*[F.col(c).cast("double") for c in features])
    return (
        panel.select(
            by, F.col(time).alias("target_date"),
            F.collect_list(step).over(frame).alias("x"),
            F.col(target).cast("double").alias("y"),
            F.count(F.lit(1)).over(frame).alias("_have"),
        )
        .filter(F.col("_have") == length)
        .drop("_have")
    )


def prepare_sequences(
    panel: DataFrame, by: str, time: str = "week_start", length: int = S.SEQUENCE_LENGTH,
    target: str = "attack_count", period: int = S.SEASONAL_LAG,
    measures: Sequence[str] = S.PANEL_MEASURES,
) -> DataFrame:
    """Seasonal lag, warm-up rows dropped, windows over the four measures."""
    needed = list(dict.fromkeys([by, time, target, *measures]))
    lagged = panel.select(*needed).transform(seasonal_lag, target, period, by=by, time=time)
    return create_sequences(
        drop_any_null(lagged), measures, target, length, by=by, time=time
    )


def combine_sequences(parts: Sequence[DataFrame]) -> DataFrame:
    """One table from per-group sequence tables."""
    combined = parts[0]
    for part in parts[1:]:
        combined = combined.unionByName(part)
    return combined


# --- scaling of window tables ---------------------------------------------------------------

def _feature_values(position: int) -> Column:
    return F.transform("x", lambda row: row[position])


def _squared_around(centre: Column):
    return lambda v: (v - centre) * (v - centre)


def fit_sequence_scaler(windows: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, min, max, mean, std_pop) over all samples and steps, and for the target 'y'.

    Each window is reduced to its mean and its squares around that mean, and the windows' means are
    combined as weighted squares around theirs, so large values lose nothing. Windows are never
    exploded, and all of a table have the same length.
    """
    zero = F.lit(0.0)
    steps = F.size("x")
    aggregates = []
    for i, name in enumerate(features):
        values = _feature_values(i)
        mean = F.aggregate(values, zero, lambda a, v: a + v) / steps
        inside = F.aggregate(F.transform(values, _squared_around(mean)), zero, lambda a, v: a + v) / steps
        low, high = F.min(F.array_min(values)), F.max(F.array_max(values))
        aggregates.append(F.struct(
            low.alias("min"), high.alias("max"), F.avg(mean).alias("mean"),
            # Rounding must not turn a constant feature into one with a tiny spread.
            F.when(low == high, 0.0).otherwise(F.sqrt(F.avg(inside) + F.var_pop(mean))).alias("std_pop"),
        ).alias(name))
    aggregates.append(F.struct(
        F.min("y").alias("min"), F.max("y").alias("max"), F.avg("y").alias("mean"),
        F.stddev_pop("y").alias("std_pop"),
    ).alias("y"))
    names = [*features, "y"]
    return (
        windows.agg(*aggregates).unpivot([], names, "feature", "_p").select("feature", "_p.*")
    )


def _shift_width(p: Column, kind: str) -> tuple[Column, Column]:
    if kind == "minmax":
        return p.getField("min"), p.getField("max") - p.getField("min")
    return p.getField("mean"), p.getField("std_pop")


def scale_sequences(
    windows: DataFrame, params: DataFrame, features: Sequence[str], kind: str = "minmax"
) -> DataFrame:
    known = params.agg(F.map_from_entries(F.collect_list(
        F.struct("feature", F.struct("min", "max", "mean", "std_pop"))
    ))).scalar()

    def scaled(value: Column, p: Column) -> Column:
        shift, width = _shift_width(p, kind)
        return F.when(width == 0, F.lit(0.0)).otherwise((value - shift) / F.when(width != 0, width))

    order = F.array(*[known.getItem(f) for f in features])
    return (
        windows.withColumn("_order", order)
        .withColumn("x", F.transform("x", lambda row: F.zip_with(row, F.col("_order"), scaled)))
        .withColumn("y", scaled(F.col("y"), known.getItem("y")))
        .drop("_order")
    )


def keep_features(windows: DataFrame, positions: Sequence[int]) -> DataFrame:
    """Windows reduced to some of their features."""
    return windows.withColumn(
        "x", F.transform("x", lambda row: F.array(*[row[i] for i in positions]))
    )


def to_vectors(windows: DataFrame, out: str = "features") -> DataFrame:
    """Flattened windows as an ML vector column."""
    from pyspark.ml.functions import array_to_vector

    return windows.withColumn(out, array_to_vector(F.flatten("x")))
