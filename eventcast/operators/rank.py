"""Positions in a total order, computed without any single-task window over the data."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from eventcast.operators.attach import attach
from eventcast.session import stage, stage_table

SLOT = "_slot"
SLOT_BYTES = 64 << 20
SLOT_ROWS = 500_000
UNKNOWN_BYTES = 1 << 50  # what a source without a size claims is beyond this
_ROW_BITS = 33  # monotonically_increasing_id: partition number above, row number within it below


def _slots(df: DataFrame) -> int:
    """Range partitions by the size of the data: of the files behind ``df``, or of its rows where there are none.

    Small tables get one per core.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    if size >= UNKNOWN_BYTES:
        return max(cores, -(-df.count() // SLOT_ROWS))
    return max(cores, -(-size // SLOT_BYTES))


def _offsets(laid: DataFrame) -> DataFrame:
    """(slot, rows in all slots before it); one row per slot."""
    before = Window.orderBy(SLOT).rowsBetween(Window.unboundedPreceding, -1)
    return laid.groupBy(SLOT).agg(F.count(F.lit(1)).alias("_rows")).select(
        SLOT, F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rank_before"))


def running_total(
    df: DataFrame,
    order: Sequence[str],
    by: Sequence[str] = (),
    weight: str | None = None,
    out: str = "running",
    fix: Callable[[DataFrame], DataFrame] = stage_table,
) -> DataFrame:
    """Inclusive running sum of ``weight`` (1 when absent) over ``order`` inside ``by``.

    ``(by, order)`` must be unique. Rows are range-partitioned on it and the layout is fixed
    by ``fix`` (a written table unless told otherwise), so a group of any size spreads over as
    many slots as it needs. A slot
    needs an offset only for the group that crosses into it, hence there are at most as many
    offsets as slots and broadcasting them is bounded.
    """
    by, order = list(by), list(order)
    amount = F.lit(1).cast("long") if weight is None else F.col(weight)
    laid = fix(
        df.repartitionByRange(_slots(df), *by, *order).withColumn(SLOT, F.spark_partition_id())
    )
    per_slot = laid.groupBy(SLOT, *by).agg(F.sum(amount).alias("_sum"))
    group = [F.col(c) for c in by] or [F.lit(0)]
    before = Window.partitionBy(*group).orderBy(SLOT).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        per_slot.withColumn("_offset", F.sum("_sum").over(before))
        .filter(F.col("_offset").isNotNull())
        .select(F.col(SLOT).alias("_o_slot"), *[F.col(c).alias(f"_o_{c}") for c in by], "_offset")
    )
    match = F.col(SLOT) == F.col("_o_slot")
    for c in by:
        match = match & F.col(c).eqNullSafe(F.col(f"_o_{c}"))
    inside = (
        Window.partitionBy(SLOT, *by).orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        laid.withColumn("_within", F.sum(amount).over(inside))
        .join(F.broadcast(offsets), match, "left")
        .withColumn(out, F.col("_within") + F.coalesce(F.col("_offset"), F.lit(0)))
        .select(*df.columns, out)
    )


def global_rank(
    df: DataFrame, order: Sequence[str], by: Sequence[str] = (), out: str = "position",
    fix: Callable[[DataFrame], DataFrame] = stage_table,
) -> DataFrame:
    """0-based position of every row in ``order`` inside ``by``.

    ``(by, order)`` must be unique. The rows are shuffled once, into sorted ranges whose number follows the
    number of rows, and every row is numbered inside its range while the layout is written (``fix``). The ranges'
    sizes, one number per range, give the global position. A group's first position comes from one aggregate over the
    layout, combined before its shuffle, so a group of any size spreads over as many ranges as it needs.
    """
    by, order = list(by), list(order)
    laid = fix(
        df.repartitionByRange(_slots(df), *by, *order).sortWithinPartitions(*by, *order)
        .withColumn("_rank_id", F.monotonically_increasing_id())
    )
    laid = laid.withColumn(SLOT, F.shiftright("_rank_id", _ROW_BITS))
    row = F.col("_rank_id").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    placed = laid.join(F.broadcast(_offsets(laid)), SLOT).withColumn(out, F.col("_rank_before") + row)
    if by:
        # A struct as key, so that null is a group like any other.
        placed = placed.withColumn("_rank_group", F.struct(*by))
        starts = placed.groupBy("_rank_group").agg(F.min(out).alias("_rank_start"))
        placed = attach(placed, starts, "_rank_group").withColumn(out, F.col(out) - F.col("_rank_start"))
    return placed.select(*df.columns, out)


def windowed_by_position(
    df: DataFrame,
    position: str,
    by: Sequence[str],
    reach: int,
    columns: dict[str, Callable[[WindowSpec], Column]],
    block: int = 100_000,
) -> DataFrame:
    """Trailing row-frame columns for groups of any size.

    Rows are cut into blocks of consecutive positions; the last ``reach`` rows of a block are
    also copied into the next one, so any frame reaching back at most ``reach`` rows is
    complete inside its block. ``columns`` maps a name to a function of the ordered window.
    """
    if block < reach:
        raise ValueError("block must be at least reach")
    home = F.floor(F.col(position) / block).cast("long")
    near_end = F.col(position) % block >= block - reach
    spread = df.withColumn("_home", home).withColumn(
        "_block", F.explode(F.when(near_end, F.array(home, home + 1)).otherwise(F.array(home)))
    )
    window = Window.partitionBy(*by, "_block").orderBy(position)
    built: dict[str, Column] = {name: make(window) for name, make in columns.items()}
    return (
        spread.select("*", *[c.alias(name) for name, c in built.items()])
        .filter(F.col("_block") == F.col("_home"))
        .select(*df.columns, *built)
    )


def kth_keys(
    df: DataFrame,
    coarse: str,
    fine: Sequence[str],
    positions: Callable[[Column], Sequence[Column]],
) -> DataFrame:
    """One row with the key struct ``(coarse, *fine)`` at each 0-based position.

    ``positions`` receives the row count. ``coarse`` must have few values compared with the
    rows (a date, a hash prefix): its counts locate the value each position falls in, and only
    the rows with those values are ordered. A position past the end gives null.
    """
    counts = stage(df.groupBy(coarse).agg(F.count(F.lit(1)).alias("_n")))
    ks = list(positions(counts.agg(F.coalesce(F.sum("_n"), F.lit(0))).scalar()))
    upto = (
        Window.partitionBy(F.lit(0)).orderBy(coarse)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    edges = counts.withColumn("_upto", F.sum("_n").over(upto)).select(
        coarse, (F.col("_upto") - F.col("_n")).alias("_start"), "_upto"
    )
    hit = F.lit(False)
    for k in ks:
        hit = hit | ((F.col("_start") <= k) & (k < F.col("_upto")))
    # At most one coarse value per requested position, so this stays tiny.
    edges = edges.filter(hit).select(coarse, "_start")
    near = df.select(coarse, *fine).join(F.broadcast(edges), coarse)
    ranked = global_rank(near, fine, [coarse], out="_at", fix=stage)
    at = F.col("_start") + F.col("_at")
    key = F.struct(coarse, *fine)
    return ranked.agg(*[F.min(F.when(at == k, key)).alias(f"cut{i}") for i, k in enumerate(ks)])
