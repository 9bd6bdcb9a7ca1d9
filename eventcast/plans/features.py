"""Composite plans over events and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventcast import schema as S
from eventcast.functions import calendar as C
from eventcast.functions import text as X
from eventcast.operators import encode, windows
from eventcast.sources.tables import with_casualties


def temporal(events: DataFrame) -> DataFrame:
    return events.withColumns(C.temporal_features(F.col("date")))


def engineer_features(events: DataFrame) -> DataFrame:
    """Casualties, calendar, holiday, recency, frequency, region and type features."""
    return (
        events.transform(with_casualties)
        .transform(temporal)
        .withColumn("is_us_holiday", C.us_holiday(F.col("date")))
        .transform(windows.history_features)
    )


def apply_encoding(events: DataFrame, columns=S.TEXT_COLUMNS) -> tuple[DataFrame, DataFrame]:
    """(encoded events, code table)."""
    codes = encode.fit_label_codes(events, columns)
    return encode.apply_label_codes(events, codes, columns), codes


def text_statistics(docs: DataFrame, text: str = "summary") -> DataFrame:
    cleaned = docs.withColumn("text_cleaned", X.clean_text(F.col(text)))
    return cleaned.withColumns({
        "text_word_count": X.word_count(F.col("text_cleaned")),
        "text_char_count": F.length("text_cleaned"),
        "has_text": X.has_text(F.col("text_cleaned")),
    })


def summary_keywords(docs: DataFrame, top_n: int = 5, cleaned: str = "text_cleaned") -> DataFrame:
    found = docs.withColumn("keywords", X.keywords(F.col(cleaned), top_n))
    return found.withColumn("keywords_text", X.keyword_text(F.col("keywords")))


def process_text(docs: DataFrame, text: str = "summary", top_n: int = 5) -> DataFrame:
    return (
        docs.transform(text_statistics, text)
        .transform(summary_keywords, top_n)
        .drop("text_cleaned", "keywords")
    )


def vocabulary_size(docs: DataFrame, keywords: str = "keywords") -> DataFrame:
    words = docs.select(F.explode(keywords).alias("word")).distinct()
    return words.agg(F.count("word").alias("vocabulary"))
