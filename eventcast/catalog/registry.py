"""Registration of queries with declared output columns.

Columns are declared once as "name type, ..." and applied to both sides, so the Spark result and
the SQL result have the same names and types. Type ``r6`` is a double rounded to six digits.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Declared type -> (Spark type, SQL type).
TYPES = {
    "int": ("int", "INTEGER"),
    "long": ("bigint", "BIGINT"),
    "double": ("double", "DOUBLE"),
    "r6": ("double", "DOUBLE"),
    "string": ("string", "VARCHAR"),
    "date": ("date", "DATE"),
    "boolean": ("boolean", "BOOLEAN"),
}


@dataclass(frozen=True)
class Query:
    key: str
    columns: tuple[tuple[str, str], ...]
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None

    def frame(self, spark: SparkSession, folder: str) -> DataFrame:
        out = []
        for name, kind in self.columns:
            c = F.col(f"`{name}`").cast(TYPES[kind][0])
            out.append((F.round(c, 6) if kind == "r6" else c).alias(name))
        return self.build(spark, folder).select(*out)

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        out = []
        for name, kind in self.columns:
            c = f'CAST("{name}" AS {TYPES[kind][1]})'
            out.append(f'{f"(round({c}, 6) + 0.0)" if kind == "r6" else c} AS "{name}"')
        return f"SELECT {', '.join(out)} FROM ({self.sql}) AS result"


_QUERIES: dict[str, Query] = {}


def query(key: str, columns: str, sql: str | None = None):
    """Decorator registering a (spark, folder) -> DataFrame function."""
    declared = tuple(tuple(part.split()) for part in columns.replace("\n", " ").split(","))

    def register(build):
        if key in _QUERIES:
            raise ValueError(f"duplicate query {key}")
        _QUERIES[key] = Query(key, declared, build, sql)
        return build

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {key: q.frame for key, q in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {key: sql for key, q in _QUERIES.items() if (sql := q.oracle()) is not None}
