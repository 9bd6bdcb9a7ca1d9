"""Cleaning, typing, filling and column selection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventcast import schema as S
from eventcast.operators.stats import percentiles

UNKNOWN = "Unknown"
BLANKS = " \t\n\r\x0b\x0c"


def _present(df: DataFrame, names: Sequence[str]) -> list[str]:
    return [c for c in names if c in df.columns]


def remove_duplicates(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def drop_critical_nulls(df: DataFrame, columns: Sequence[str] = S.CRITICAL_COLUMNS) -> DataFrame:
    return df.dropna("any", subset=_present(df, columns))


def fill_numeric_nulls(df: DataFrame, columns: Sequence[str] = ("nkill", "nwound")) -> DataFrame:
    return df.fillna(0, subset=_present(df, columns))


def fill_categorical_nulls(
    df: DataFrame, columns: Sequence[str] = S.UNKNOWN_FILLED_COLUMNS
) -> DataFrame:
    return df.fillna(UNKNOWN, subset=_present(df, columns))


def null_audit(df: DataFrame) -> DataFrame:
    """(column_name, nulls) for every column from a single pass."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return counts.unpivot([], df.columns, "column_name", "nulls")


def handle_missing_values(df: DataFrame) -> DataFrame:
    return (
        df.transform(drop_critical_nulls)
        .transform(fill_numeric_nulls)
        .transform(fill_categorical_nulls)
    )


def parse_number(value: Column) -> Column:
    """Number or null; text that is no number and NaN are both null."""
    return F.nanvl(value.try_cast("double"), F.lit(None).cast("double"))


def parse_whole(value: Column) -> Column:
    """Whole number or null; '3.0' and '3e0' count as 3, '3.5' as no whole number."""
    plain = F.regexp_replace(value.cast("string"), r"\.0*\s*$", "").try_cast("int")
    number = parse_number(value)
    return F.coalesce(plain, F.when(number == F.floor(number), number.try_cast("int")))


def valid_date(year: Column, month: Column, day: Column) -> Column:
    """Date of the parts, null unless they name a calendar day; nothing is parsed.

    Each part occurs once: a filter on the date is pushed below the cleaning steps and carries
    the parts' own expressions with it.
    """
    zero = F.lit(0)
    return F.try_make_timestamp_ntz(year, month, day, zero, zero, zero).cast("date")


def fix_data_types(df: DataFrame) -> DataFrame:
    typed = {c: parse_whole(F.col(c)) for c in _present(df, ["iyear", "imonth", "iday"])}
    typed |= {
        c: F.coalesce(parse_number(F.col(c)), F.lit(0.0)) for c in _present(df, ["nkill", "nwound"])
    }
    typed |= {c: parse_number(F.col(c)) for c in _present(df, ["latitude", "longitude"])}
    return df.withColumns(typed)


def create_date_column(df: DataFrame) -> DataFrame:
    """Zero month or day becomes 1; rows whose parts are no calendar date are dropped."""
    repaired = df.withColumns(
        {c: F.when(F.col(c) == 0, 1).otherwise(F.col(c)) for c in ("imonth", "iday")}
    )
    date = valid_date(F.col("iyear"), F.col("imonth"), F.col("iday"))
    return repaired.withColumn("date", date).filter(F.col("date").isNotNull())


def validate_coordinates(df: DataFrame) -> DataFrame:
    """Either coordinate out of range nulls both; the row stays."""
    if not {"latitude", "longitude"} <= set(df.columns):
        return df
    none = F.lit(None).cast("double")
    lat, lon = F.nanvl("latitude", none), F.nanvl("longitude", none)
    bad = F.coalesce(~lat.between(-90, 90), F.lit(False)) | F.coalesce(
        ~lon.between(-180, 180), F.lit(False)
    )
    return df.withColumns({"latitude": F.when(~bad, lat), "longitude": F.when(~bad, lon)})


def standardize_text_fields(df: DataFrame, columns: Sequence[str] = S.TEXT_COLUMNS) -> DataFrame:
    # The reference result for an all-blank value and for the literal text 'nan' is Unknown.
    def tidy(c: str) -> Column:
        trimmed = F.btrim(F.col(c).cast("string"), F.lit(BLANKS))
        return F.coalesce(F.nullif(F.nullif(trimmed, F.lit("")), F.lit("nan")), F.lit(UNKNOWN))

    return df.withColumns({c: tidy(c) for c in _present(df, columns)})


def select_relevant_columns(df: DataFrame, keep: Sequence[str] = S.KEPT_COLUMNS) -> DataFrame:
    return df.select(*_present(df, keep))


def clean_data(raw: DataFrame) -> DataFrame:
    """The whole cleaning chain as one lazy plan."""
    return (
        raw.transform(remove_duplicates)
        .transform(fix_data_types)
        .transform(create_date_column)
        .transform(handle_missing_values)
        .transform(validate_coordinates)
        .transform(standardize_text_fields)
        .transform(select_relevant_columns)
    )


def rename_columns(df: DataFrame, names: Mapping[str, str] = S.LEGACY_NAMES) -> DataFrame:
    return df.withColumnsRenamed({old: new for old, new in names.items() if old in df.columns})


def impute_median(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Null becomes the exact median of the column; all columns are searched in the same passes."""
    found = percentiles(df, columns, [0.5]).collect()  # one row per column
    medians = {r["column_name"]: r["p0"] for r in found}
    return df.withColumns({
        c: F.coalesce(F.col(c).cast("double"), F.lit(medians.get(c)).cast("double")) for c in columns
    })


def impute_mode(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Null becomes the most frequent value; the smallest of several."""
    filled = {}
    for c in columns:
        counts = df.filter(F.col(c).isNotNull()).groupBy(c).count()
        mode = counts.agg(F.min_by(c, F.struct(-F.col("count"), F.col(c)))).scalar()
        filled[c] = F.coalesce(F.col(c), mode)
    return df.withColumns(filled)


def remap_values(df: DataFrame, column: str, mapping: Mapping[str, str]) -> DataFrame:
    return df.replace(dict(mapping), subset=[column])


def padded_date(df: DataFrame) -> DataFrame:
    """Text date from text parts: pad to two digits, '00' becomes '01', join by '-'."""

    def part(c: str) -> Column:
        padded = F.lpad(F.col(c).cast("string"), 2, "0")
        return F.when(padded == "00", F.lit("01")).otherwise(padded)

    return df.withColumns({"Month": part("Month"), "Day": part("Day")}).withColumn(
        "Date", F.concat_ws("-", F.col("Year").cast("string"), "Month", "Day")
    )


def fill_defaults(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    return df.fillna({c: v for c, v in defaults.items() if c in df.columns})


def drop_missing_coordinates(df: DataFrame) -> DataFrame:
    return df.dropna("any", subset=["latitude", "longitude"])


def drop_any_null(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.dropna("any", subset=list(columns) if columns else None)


def fill_feature_nulls(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    names = list(columns) if columns else S.numeric_columns(df.schema)
    return df.fillna(0, subset=names)


def drop_columns(df: DataFrame, *names: str) -> DataFrame:
    return df.drop(*names)


def feature_columns(df: DataFrame, target: str, exclude: Sequence[str] = ()) -> list[str]:
    """Numeric columns other than the target and the excluded ones."""
    return [c for c in S.numeric_columns(df.schema) if c != target and c not in exclude]


def select_features(df: DataFrame, target: str, exclude: Sequence[str] = ()) -> DataFrame:
    return df.select(*feature_columns(df, target, exclude), target)


def recent_span(df: DataFrame, date: str, months: int = 60) -> DataFrame:
    """Rows within ``months`` of the latest date."""
    latest = df.agg(F.max(date)).scalar()
    return df.filter(F.col(date) >= F.add_months(latest, -months))

