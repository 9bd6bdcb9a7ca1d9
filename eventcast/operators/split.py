"""Chronological, per-series and random splits as a ``split`` column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventcast import schema as S
from eventcast.operators.rank import kth_keys


def _ahead(columns: Sequence[str], key: Sequence) -> Column:
    """True for rows before ``key`` in the order of ``columns``."""
    first, value = F.col(columns[0]), F.lit(key[0])
    if len(columns) == 1:
        return first < value
    return (first < value) | ((first == value) & _ahead(columns[1:], key[1:]))


def _before(df: DataFrame, coarse: str, fine: Sequence[str], positions) -> list[Column]:
    """Per position, a column that is true for the rows ahead of it in the order.

    Only the key found at each position comes to the driver. Rows are compared with it as a
    literal, so wide rows are never shuffled and a filter on the split reaches the scan. Rows with
    a null in the order have no place in it: they are not counted and are ahead of nothing.
    """
    columns = [coarse, *fine]
    cuts = kth_keys(df.dropna(subset=columns), coarse, fine, positions).first()
    placed = F.lit(True)
    for c in columns:
        placed = placed & F.col(c).isNotNull()
    return [placed if key is None else placed & _ahead(columns, key) for key in cuts]


def _placed(label: Column, columns: Sequence[str]) -> Column:
    """``label`` for rows that have a place in the order, null for those with a null in it."""
    for c in columns:
        label = F.when(F.col(c).isNotNull(), label)
    return label


def split_column(
    df: DataFrame, date: str, ties: Sequence[str], ratios: Sequence[float] = S.SPLIT_RATIOS
) -> Column:
    """Label column for any table with the same keys as ``df``.

    train = first floor(n*r1) rows by date, val = next floor(n*r2), test = the rest; n counts the
    rows with all keys, and the others get a null.
    """
    first, second = float(ratios[0]), float(ratios[1])

    def positions(n: Column) -> list[Column]:
        train = F.floor(n * F.lit(first))
        return [train, train + F.floor(n * F.lit(second))]

    in_train, in_val = _before(df, date, ties, positions)
    return _placed(F.when(in_train, "train").when(in_val, "val").otherwise("test"), [date, *ties])


def chronological_split(
    df: DataFrame, date: str, ties: Sequence[str], ratios: Sequence[float] = S.SPLIT_RATIOS
) -> DataFrame:
    return df.withColumn("split", split_column(df, date, ties, ratios))


def two_way_split(
    df: DataFrame, date: str, ties: Sequence[str], train_ratio: float = 0.8
) -> DataFrame:
    (in_train,) = _before(df, date, ties, lambda n: [F.floor(n * F.lit(float(train_ratio)))])
    label = F.when(in_train, "train").otherwise("test")
    return df.withColumn("split", _placed(label, [date, *ties]))


def tail_validation(
    df: DataFrame, date: str, ties: Sequence[str], share: float = 0.15
) -> DataFrame:
    """The last ``floor(n*share)`` train rows become validation."""
    train = df.filter(F.col("split") == "train")
    (stays,) = _before(train, date, ties, lambda n: [n - F.floor(n * F.lit(float(share)))])
    return df.withColumn(
        "split", F.when((F.col("split") == "train") & ~stays, "val").otherwise(F.col("split"))
    )


def series_split(
    panel: DataFrame, by: str, time: str, ratios: Sequence[float] = S.SPLIT_RATIOS
) -> DataFrame:
    """Chronological split inside each series; cuts at floor(n*r1) and floor(n*(r1+r2))."""
    number = F.row_number().over(Window.partitionBy(by).orderBy(time))
    size = F.count(F.lit(1)).over(Window.partitionBy(by))
    train_end = F.floor(size * F.lit(float(ratios[0])))
    val_end = F.floor(size * F.lit(float(ratios[0]) + float(ratios[1])))
    return panel.withColumn(
        "split",
        F.when(number <= train_end, "train").when(number <= val_end, "val").otherwise("test"),
    )


def random_split(
    df: DataFrame, row_id: str, train_ratio: float = 0.8, seed: int = S.SEED
) -> DataFrame:
    """Exactly floor(n*ratio) rows in train, chosen by a seeded hash of the row id.

    The first hash digits spread rows over 65,536 cells, so only the one cell that holds the
    cut is ever ordered.
    """
    hashed = df.withColumn(
        "_hash", F.md5(F.concat_ws(":", F.col(row_id).cast("string"), F.lit(str(seed))))
    ).withColumn("_cell", F.substring("_hash", 1, 4))
    (in_train,) = _before(
        hashed, "_cell", ["_hash", row_id], lambda n: [F.floor(n * F.lit(float(train_ratio)))]
    )
    return hashed.withColumn("split", F.when(in_train, "train").otherwise("test")).drop(
        "_hash", "_cell"
    )


def split_summary(df: DataFrame, date: str) -> DataFrame:
    return df.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.min(date).alias("first_date"), F.max(date).alias("last_date")
    )
