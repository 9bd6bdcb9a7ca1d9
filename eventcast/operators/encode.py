"""Label codes, one-hot columns, scalers and vector assembly."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventcast import schema as S
from eventcast.operators.attach import attach, attach_codes
from eventcast.operators.rank import global_rank
from eventcast.session import stage


# --- label codes ----------------------------------------------------------------------------

def fit_label_codes(
    df: DataFrame, columns: Sequence[str] = S.TEXT_COLUMNS, null_value: str | None = None
) -> DataFrame:
    """(column_name, value, code): sorted distinct values numbered from 0; absent columns skipped.

    Nulls get no code, or with ``null_value`` the code of that text.
    """
    present = [c for c in columns if c in df.columns]
    cells = F.array(*[
        F.struct(F.lit(c).alias("column_name"), _text(c, null_value).alias("value"))
        for c in present
    ])
    values = stage(df.select(F.inline(cells)).filter(F.col("value").isNotNull()).distinct())
    placed = global_rank(values, ["column_name", "value"], out="_at", fix=stage)
    # One row per column.
    first = F.broadcast(placed.groupBy("column_name").agg(F.min("_at").alias("_first")))
    code = (F.col("_at") - F.col("_first")).cast("int").alias("code")
    return stage(placed.join(first, "column_name").select("column_name", "value", code))


def _text(column: str, null_value: str | None) -> Column:
    text = F.col(column).cast("string")
    return text if null_value is None else F.coalesce(text, F.lit(null_value))


def apply_label_codes(
    df: DataFrame, codes: DataFrame, columns: Sequence[str], null_value: str | None = None
) -> DataFrame:
    """Adds ``<column>_encoded``; codes come from ``fit_label_codes`` or a stored table."""
    return attach_codes(df, codes, {c: f"{c}_encoded" for c in columns}, null_value=null_value)


def decode_labels(df: DataFrame, codes: DataFrame, column: str, code: str, out: str) -> DataFrame:
    lookup = codes.filter(F.col("column_name") == column).select(
        F.col("code").alias(code), F.col("value").alias(out)
    )
    return attach(df, lookup, code, staged=True)


# --- one-hot --------------------------------------------------------------------------------

def one_hot(df: DataFrame, values: dict[str, Sequence[str]]) -> DataFrame:
    """One 0/1 column per listed value, no level dropped."""
    return df.withColumns({
        f"{c}_{v}": F.coalesce((F.col(c) == v).cast("int"), F.lit(0))
        for c, levels in values.items()
        for v in levels
    })


def category_levels(df: DataFrame, columns: Sequence[str], limit: int = 200) -> dict[str, list[str]]:
    """Distinct values per column for ``one_hot``; refuses columns too wide for columns."""
    levels = {}
    for c in columns:
        found = [r[0] for r in df.select(c).filter(F.col(c).isNotNull()).distinct().limit(limit + 1).collect()]
        if len(found) > limit:
            raise ValueError(f"{c} has more than {limit} values; use one_hot_vectors")
        levels[c] = sorted(found)
    return levels


def one_hot_vectors(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, PipelineModel]:
    """Sparse vectors for columns with many values; no level dropped.

    The fitted indexer holds the distinct values of each column, not the rows.
    """
    stages = [
        StringIndexer(inputCol=c, outputCol=f"{c}_index", stringOrderType="alphabetAsc",
                      handleInvalid="keep")
        for c in columns
    ]
    stages.append(OneHotEncoder(
        inputCols=[f"{c}_index" for c in columns], outputCols=[f"{c}_vec" for c in columns],
        dropLast=False,
    ))
    model = Pipeline(stages=stages).fit(df)
    return model.transform(df), model


# --- scalers --------------------------------------------------------------------------------

def fit_scaler(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, min, max, mean, std_pop), one row per column, from one aggregation."""
    row = df.agg(*[
        F.struct(
            F.min(F.col(c).cast("double")).alias("min"), F.max(F.col(c).cast("double")).alias("max"),
            F.avg(c).alias("mean"), F.stddev_pop(c).alias("std_pop"),
        ).alias(c)
        for c in columns
    ])
    return row.unpivot([], list(columns), "feature", "_p").select("feature", "_p.*")


def _scale(x: Column, p: Column, kind: str) -> Column:
    if kind == "minmax":
        shift, width = p.getField("min"), p.getField("max") - p.getField("min")
    elif kind == "standard":
        shift, width = p.getField("mean"), p.getField("std_pop")
    else:
        raise ValueError(f"unknown scaler {kind}")
    return F.when(width == 0, F.lit(0.0)).otherwise((x - shift) / F.when(width != 0, width))


def _parameter_map(params: DataFrame) -> Column:
    # One entry per feature of the schema, so the map stays as small as the column list.
    return params.agg(F.map_from_entries(F.collect_list(
        F.struct("feature", F.struct("min", "max", "mean", "std_pop"))
    ))).scalar()


def apply_scaler(
    df: DataFrame, params: DataFrame, columns: Sequence[str], kind: str = "minmax"
) -> DataFrame:
    """Scaled columns in place; a constant column becomes 0."""
    known = _parameter_map(params)
    return df.withColumns({
        c: _scale(F.col(c).cast("double"), known.getItem(c), kind) for c in columns
    })


def unscale(
    df: DataFrame, params: DataFrame, feature: str, columns: Sequence[str], kind: str = "minmax"
) -> DataFrame:
    """Scaled values of ``feature`` back to the original unit."""
    p = _parameter_map(params).getItem(feature)
    if kind == "minmax":
        shift, width = p.getField("min"), p.getField("max") - p.getField("min")
    else:
        shift, width = p.getField("mean"), p.getField("std_pop")
    return df.withColumns({c: F.col(c) * width + shift for c in columns})


# --- vectors --------------------------------------------------------------------------------

def assemble(df: DataFrame, columns: Sequence[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol=out, handleInvalid="keep").transform(df)


def node_block(
    df: DataFrame, key: str, categorical: Sequence[str], numeric: Sequence[str], binary: Sequence[str],
    vectors: DataFrame | None = None, word: str | None = None, vector_size: int = 0,
) -> DataFrame:
    """(key, size, indices, values): sparse node features of every row.

    In order: a one-hot block per categorical column, no level dropped; the numeric columns, standardised over all rows;
    the 0/1 columns; the vector of the row's word. The categories stay a distributed dictionary: only the width of each
    block comes to the driver. Nulls, absent words and zeros have no entry.
    """
    codes = fit_label_codes(df, categorical)
    widths = {r["column_name"]: r["count"] for r in codes.groupBy("column_name").count().collect()}
    rows = apply_label_codes(df, codes, categorical)
    rows = apply_scaler(rows, fit_scaler(df, numeric), numeric, "standard")
    entries, at = [], 0

    def entry(index: Column, value: Column) -> Column:
        return F.struct(index.cast("int").alias("index"), value.cast("double").alias("value"))

    for c in categorical:
        entries.append(entry(F.col(f"{c}_encoded") + at, F.when(F.col(f"{c}_encoded").isNotNull(), 1.0)))
        at += widths.get(c, 0)
    for c in [*numeric, *binary]:
        entries.append(entry(F.lit(at), F.col(c).cast("double")))
        at += 1
    found = F.array(*entries)
    if vectors is not None:
        lookup = vectors.select(F.col("word").alias(word), F.col("vector").alias("_vector"))
        rows = attach(rows, lookup, word, staged=True)
        part = F.transform(F.coalesce("_vector", F.array().cast("array<double>")), lambda v, k: entry(k + at, v))
        found, at = F.concat(found, part), at + vector_size
    found = F.filter(found, lambda x: x["value"].isNotNull() & (x["value"] != 0))
    return rows.select(key, F.lit(at).alias("size"), found.alias("_entries")).select(
        key, "size", F.transform("_entries", lambda x: x["index"]).alias("indices"),
        F.transform("_entries", lambda x: x["value"]).alias("values"))


def non_finite_check(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, has_nan, has_infinity)."""
    infinity = float("inf")
    row = df.agg(*[
        F.struct(
            F.coalesce(F.bool_or(F.isnan(F.col(c).cast("double"))), F.lit(False)).alias("has_nan"),
            F.coalesce(
                F.bool_or(F.abs(F.col(c).cast("double")) == infinity), F.lit(False)
            ).alias("has_infinity"),
        ).alias(c)
        for c in columns
    ])
    return row.unpivot([], list(columns), "column_name", "_c").select("column_name", "_c.*")
