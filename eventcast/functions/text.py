"""Text expressions; whole texts, no Python on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stop words and the longest word length that is still dropped.
STOP_WORDS = [
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from",
    "as", "is", "was", "were", "be", "been", "being", "have", "has", "had",
]
SHORT_WORD = 3
# Blanks of any script, and the four separators among the control characters.
BLANK = r"\s\x1c-\x1f\x85\p{Z}"


def clean_text(text: Column) -> Column:
    """Lower-case letters and single spaces only; null or 'Unknown' gives ''."""
    letters = F.regexp_replace(F.lower(text), f"[^a-zA-Z{BLANK}]", "")
    spaced = F.trim(F.regexp_replace(letters, f"[{BLANK}]+", " "))
    return F.when(text.isNull() | (text == "Unknown"), F.lit("")).otherwise(spaced)


def words(cleaned: Column) -> Column:
    return F.filter(F.split(cleaned, " "), lambda w: w != "")


def keywords(cleaned: Column, top_n: int = 5) -> Column:
    """First ``top_n`` distinct long non-stop words in order of appearance."""
    kept = F.filter(
        F.split(cleaned, " "), lambda w: (F.length(w) > SHORT_WORD) & ~w.isin(STOP_WORDS)
    )
    return F.slice(F.array_distinct(kept), 1, top_n)


def keyword_text(found: Column) -> Column:
    return F.array_join(found, ", ")


def word_count(cleaned: Column) -> Column:
    return F.size(words(cleaned))


def has_text(cleaned: Column) -> Column:
    return F.when(F.length(cleaned) > 0, 1).otherwise(0)
