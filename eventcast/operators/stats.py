"""Descriptive statistics and the data behind the reference's figures."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventcast.operators.attach import attach
from eventcast.session import stage


CELLS = 4096
LAST_CELL_ROWS = 1_000_000
BROADCAST_RANKS = 100_000  # cells of a hundred bytes at most


def _magnitude(v: Column) -> Column:
    """Cell of a value by sign and logarithm: no order is broken, and a cell spans less than a factor of two."""
    size = F.greatest(F.lit(-2000), F.least(F.lit(4000), F.floor(F.log(F.abs(v)) * 2))) + 2500
    return F.when(F.isnan(v), 9000).when(v == 0, 0).otherwise(F.signum(v).cast("long") * size).cast("double")


def _hits(cells: DataFrame, ranks: Column) -> DataFrame:
    """Per wanted rank, the one cell that holds it; ``cells``: (…, _cell, _n, _low, _high, _below)."""
    parts = [c for c in cells.columns if c not in ("_cell", "_n", "_low", "_high", "_below", "_ranks")]
    upto = Window.partitionBy(*parts).orderBy("_cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = cells.withColumn("_upto", F.col("_below") + F.sum("_n").over(upto))
    first = F.col("_upto") - F.col("_n")
    held = F.filter(ranks, lambda k: (k >= first) & (k < F.col("_upto")))
    return placed.withColumn("_below", first).withColumn("_rank_at", F.explode(held))


def percentiles(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], by: Sequence[str] = ()
) -> DataFrame:
    """(by, column_name, p0, p1, ...): exact linearly interpolated percentiles of many columns per group.

    Selection by narrowing; values are never put in order. The first pass counts the values of all columns and groups
    in cells of sign and magnitude. Each further pass counts only the values inside the cells that hold a wanted rank, in
    equal parts between their least and greatest value, until such a cell holds one value; once the cells hold few
    rows altogether, their values are counted singly. A pass is one scan and shuffles counts of cells only. NaN comes
    after infinity. A column or group without values has no row.
    """
    by = list(by)
    group = F.struct(*by) if by else F.lit(0)
    melted = F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("_value")) for c in columns]))
    values = df.select(group.alias("_group"), melted).filter(F.col("_value").isNotNull())
    bounds = (F.count(F.lit(1)).alias("_n"), F.min("_value").alias("_low"), F.max("_value").alias("_high"))

    def ranks(total: Column) -> Column:
        places = [(total - 1) * F.lit(float(p)) for p in probabilities]
        return F.array_distinct(F.array(*[f(x) for x in places for f in (F.floor, F.ceil)]))

    keys = ["_group", "column_name"]
    cells = values.groupBy(*keys, _magnitude(F.col("_value")).alias("_cell")).agg(*bounds)
    total = F.sum("_n").over(Window.partitionBy(*keys))
    cells = cells.withColumns({"_total": total, "_below": F.lit(0).cast("long")})
    state_columns = [*keys, "_total", "_rank_at", "_n", "_low", "_high", "_below"]
    state = stage(_hits(cells, ranks(F.col("_total"))).select(*state_columns))
    solved = None
    while True:
        single = F.col("_low") == F.col("_high")
        open_ = state.filter(~single)
        left, searched = open_.agg(F.sum("_n"), F.count(F.lit(1))).first()
        solved = state.filter(single) if solved is None else solved.unionByName(state.filter(single))
        if not left:
            break
        wanted = open_.groupBy(*keys).agg(F.collect_list(F.struct(
            "_rank_at", "_total", F.col("_low").alias("_from"), F.col("_high").alias("_to"), "_below")).alias("_open"))
        few = searched <= BROADCAST_RANKS
        near = values.join(F.broadcast(wanted), keys) if few else attach(values, wanted, keys, "inner")
        inside = F.filter("_open", lambda t: F.col("_value").between(t["_from"], t["_to"]))
        near = near.select(*keys, "_value", F.inline(inside))
        cell = F.col("_value")
        if left > LAST_CELL_ROWS:
            cell = F.floor((cell - F.col("_from")) / (F.col("_to") - F.col("_from")) * CELLS).cast("double")
        parts = near.groupBy(*keys, "_total", "_rank_at", cell.alias("_cell")).agg(*bounds, F.first("_below").alias("_below"))
        parts = parts.withColumnRenamed("_rank_at", "_wanted")
        state = stage(_hits(parts, F.array("_wanted")).select(*state_columns))

    picks = []
    for i, p in enumerate(probabilities):
        place = (F.col("_total") - 1) * F.lit(float(p))
        for name, at in (("l", F.floor(place)), ("h", F.ceil(place))):
            picks.append(F.max(F.when(F.col("_rank_at") == at, F.col("_low"))).alias(f"_{name}{i}"))
        picks.append(F.max(place - F.floor(place)).alias(f"_f{i}"))
    found = solved.groupBy(*keys).agg(*picks)
    return found.select(*[F.col("_group").getField(c).alias(c) for c in by], "column_name", *[
        (F.col(f"_l{i}") + (F.col(f"_h{i}") - F.col(f"_l{i}")) * F.col(f"_f{i}")).alias(f"p{i}")
        for i in range(len(probabilities))
    ])


def exact_percentiles(
    df: DataFrame, column: str, probabilities: Sequence[float], by: Sequence[str] = ()
) -> DataFrame:
    """Exact percentiles ``p0, p1, ...`` of one column per group."""
    return percentiles(df, [column], probabilities, by).drop("column_name")


def series_summary(df: DataFrame, date: str, value: str) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("n"),
        F.min(date).alias("first_date"),
        F.max(date).alias("last_date"),
        F.avg(value).alias("mean"),
        F.stddev_pop(value).alias("std"),
    )


def describe(df: DataFrame, column: str) -> DataFrame:
    """count, mean, sample std, min, quartiles and max as one row."""
    moments = df.agg(
        F.count(column).alias("count"),
        F.avg(column).alias("mean"),
        F.stddev_samp(column).alias("std"),
        F.min(column).alias("min"),
        F.max(column).alias("max"),
    )
    quartiles = exact_percentiles(df, column, [0.25, 0.5, 0.75])
    found = quartiles.select(F.struct("p0", "p1", "p2")).scalar()
    return moments.select(
        "count", "mean", "std", "min",
        found.getField("p0").alias("q25"),
        found.getField("p1").alias("q50"),
        found.getField("p2").alias("q75"),
        "max",
    )


def flag_summary(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    """(flag, total, rate) of 0/1 columns or measures, one pass."""
    sums = df.agg(*[
        F.struct(F.sum(c).cast("double").alias("total"), F.avg(c).alias("rate")).alias(c)
        for c in flags
    ])
    return sums.unpivot([], list(flags), "flag", "_v").select("flag", "_v.total", "_v.rate")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    counts = stage(df.groupBy(column).agg(F.count(F.lit(1)).alias("n")))
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("percent", F.col("n") * 100.0 / total)


def box_stats(df: DataFrame, column: str, by: str, reach: float = 1.5) -> DataFrame:
    """Quartiles, whiskers at ``reach`` IQR and the number of values beyond them."""
    quartiles = exact_percentiles(df, column, [0.25, 0.5, 0.75], [by])
    fences = quartiles.select(
        by,
        F.col("p0").alias("q1"), F.col("p1").alias("median"), F.col("p2").alias("q3"),
        (F.col("p0") - (F.col("p2") - F.col("p0")) * reach).alias("low_fence"),
        (F.col("p2") + (F.col("p2") - F.col("p0")) * reach).alias("high_fence"),
    )
    inside = F.col(column).between(F.col("low_fence"), F.col("high_fence"))
    held = attach(df.select(by, column).filter(F.col(column).isNotNull()), fences, by, "inner")
    return held.groupBy(by, "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col(column))).alias("low_whisker"),
        F.max(F.when(inside, F.col(column))).alias("high_whisker"),
        F.count_if(~inside).alias("outliers"),
    )


WIDE = 32  # columns beyond which pairs are computed in blocks
GRAM_BLOCK = 64
MERGED_PARTITIONS = 128
_PARTS = 6  # per pair of columns: rows with both, sums, sums of squares of either, sum of products


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Long-form Pearson matrix over the rows where both columns have a value; both triangles from the upper one.

    Up to ``WIDE`` columns every pair is one aggregate; more go through ``correlation_blocks``.
    """
    if len(columns) > WIDE:
        return correlation_blocks(df, columns)
    pairs = list(combinations_with_replacement(columns, 2))
    row = df.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    cells = F.array(*[
        F.struct(F.lit(a).alias("row_name"), F.lit(b).alias("column_name"),
                 F.col(f"`{x}|{y}`").alias("correlation"))
        for x, y in pairs
        for a, b in sorted({(x, y), (y, x)})
    ])
    return row.select(F.inline(cells))


def _moved(block: np.ndarray, by_row: np.ndarray, by_column: np.ndarray) -> np.ndarray:
    """Sums of a block as if its values had been lower by ``by_row`` (its rows) and ``by_column``."""
    n, x, y, xx, yy, xy = block
    r, c = by_row[:, None], by_column[None, :]
    return np.stack([n, x - n * r, y - n * c, xx - 2 * r * x + n * r * r, yy - 2 * c * y + n * c * c, xy - c * x - r * y + n * r * c])


def correlation_blocks(df: DataFrame, columns: Sequence[str], block: int = GRAM_BLOCK) -> DataFrame:
    """Long-form Pearson matrix of many columns from one scan, null when a pair has no spread.

    Every partition adds up, for blocks of columns, the products of its values less the partition's own means, with
    counts and sums over the rows that have both. Blocks meet in two shuffles, are moved to common centres and added,
    so no sum loses digits to a large mean and no task holds more than some blocks.
    """
    columns = list(columns)
    cuts = list(range(0, len(columns), block))
    pairs = [(i, j) for i in range(len(cuts)) for j in range(i, len(cuts))]
    schema = "i int, j int, part int, centres binary, sums binary"

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, total, part = None, {}, TaskContext.get().partitionId() // MERGED_PARTITIONS
        for batch in batches:
            if not batch.num_rows:
                continue
            values = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(np.float64)
            there = np.column_stack([c.is_valid().to_numpy(zero_copy_only=False) for c in batch.columns]).astype(np.float64)
            values[there == 0] = 0
            if centre is None:
                centre = values.sum(0) / np.maximum(there.sum(0), 1)
            values = (values - centre) * there
            squares = values * values
            for i, j in pairs:
                a, b = (slice(cuts[k], cuts[k] + block) for k in (i, j))
                m, k = there[:, a].T, there[:, b]
                sums = np.stack([m @ k, values[:, a].T @ k, m @ values[:, b], squares[:, a].T @ k, m @ squares[:, b],
                                 values[:, a].T @ values[:, b]])
                total[i, j] = total[i, j] + sums if (i, j) in total else sums
        if centre is not None:
            found = [(i, j, part, np.concatenate([centre[cuts[i]:cuts[i] + block], centre[cuts[j]:cuts[j] + block]]).tobytes(),
                      total[i, j].tobytes()) for i, j in pairs]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*found), (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()))],
                names=["i", "j", "part", "centres", "sums"])

    def added(group: pa.Table) -> pa.Table:
        i, j = group["i"][0].as_py(), group["j"][0].as_py()
        rows, width = min(block, len(columns) - cuts[i]), min(block, len(columns) - cuts[j])
        centre, total = None, 0
        order = np.argsort([c.as_py() for c in group["centres"]], kind="stable")  # sums in an order of their own
        for at in order.tolist():
            mine = np.frombuffer(group["centres"][at].as_py())
            sums = np.frombuffer(group["sums"][at].as_py()).reshape(_PARTS, rows, width)
            centre = mine if centre is None else centre
            total = total + _moved(sums, centre[:rows] - mine[:rows], centre[rows:] - mine[rows:])
        return pa.table({"i": pa.array([i], pa.int32()), "j": pa.array([j], pa.int32()), "part": pa.array([0], pa.int32()),
                         "centres": pa.array([centre.tobytes()], pa.binary()), "sums": pa.array([total.tobytes()], pa.binary())})

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, sums in zip(*(batch.column(c).to_pylist() for c in ("i", "j", "sums"))):
                names = columns[cuts[i]:cuts[i] + block], columns[cuts[j]:cuts[j] + block]
                n, x, y, xx, yy, xy = np.frombuffer(sums).reshape(_PARTS, len(names[0]), len(names[1]))
                with np.errstate(all="ignore"):
                    spread_x, spread_y = xx - x * x / n, yy - y * y / n
                    flat = (spread_x <= 1e-14 * xx) | (spread_y <= 1e-14 * yy) | (n < 2)
                    r = np.clip((xy - x * y / n) / np.sqrt(spread_x * spread_y), -1, 1)
                missing = flat | ~np.isfinite(r)
                left, right = (np.array(v) for v in names)
                for a, b, value, none in ((left, right, r, missing), (right, left, r.T, missing.T))[: 1 if i == j else 2]:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(a, len(b))), pa.array(np.tile(b, len(a))), pa.array(value.ravel(), mask=none.ravel())],
                        names=["row_name", "column_name", "correlation"])

    sums = df.select(*[F.col(c).cast("double").alias(f"c{k}") for k, c in enumerate(columns)]).mapInArrow(gather, schema)
    sums = sums.groupBy("i", "j", "part").applyInArrow(added, schema)
    sums = sums.groupBy("i", "j").applyInArrow(added, schema)
    return sums.mapInArrow(finished, "row_name string, column_name string, correlation double")


def sum_by(df: DataFrame, key: str, column: str, out: str = "total") -> DataFrame:
    return df.groupBy(key).agg(F.sum(column).alias(out))


def grid_histogram(
    df: DataFrame, x: str, y: str, width: float, keys: Sequence[str] = ()
) -> DataFrame:
    """Row counts per square cell (and per extra key)."""
    cells = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(
        *keys,
        F.floor(F.col(x) / width).cast("long").alias(f"{x}_cell"),
        F.floor(F.col(y) / width).cast("long").alias(f"{y}_cell"),
    )
    return cells.groupBy(*cells.columns).agg(F.count(F.lit(1)).alias("n"))


def distinct_count(df: DataFrame, columns: Sequence[str], approximate: bool = False) -> DataFrame:
    """Distinct values per column.

    Exact counts go through one long (column, value) table so that every column is
    deduplicated in the same shuffle instead of expanding the rows once per column.
    """
    if approximate:
        row = df.agg(*[F.approx_count_distinct(c).alias(c) for c in columns])
        return row.unpivot([], list(columns), "column_name", "n_distinct")
    return (
        df.select(F.inline(F.array(*[
            F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value"))
            for c in columns
        ])))
        .distinct().groupBy("column_name").agg(F.count("value").alias("n_distinct"))
    )


# --- distinct counts over any span ----------------------------------------------------------

SKETCH_BITS = 12


def distinct_sketches(
    df: DataFrame, period: str, columns: Sequence[str], bits: int = SKETCH_BITS
) -> DataFrame:
    """(period, column_name, sketch): mergeable sketches, one per period and column.

    Stored once, they answer for any set of periods without reading the events again.
    """
    row = df.groupBy(period).agg(*[F.hll_sketch_agg(F.col(c).cast("string"), F.lit(bits)).alias(c) for c in columns])
    return row.unpivot([period], list(columns), "column_name", "sketch")


def distinct_between(sketches: DataFrame, period: str, first: Column, last: Column) -> DataFrame:
    """(column_name, n_distinct): estimated distinct values over the periods from ``first`` to ``last``."""
    return sketches.filter(F.col(period).between(first, last)).transform(distinct_united, [])


def distinct_united(sketches: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, column_name, n_distinct): sketches united per group, of one or several periods."""
    return sketches.groupBy(*by, "column_name").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_distinct"))


def sketch_error(bits: int = SKETCH_BITS) -> float:
    """Three standard errors of an estimate, as a share of the true count."""
    return 3 * 1.04 / 2 ** (bits / 2)
