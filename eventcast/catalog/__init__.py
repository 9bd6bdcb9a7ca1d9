"""Registered queries: one per inventory row, each with its SQL oracle where SQL can express it."""

from eventcast.catalog import (  # noqa: F401  (importing registers the queries)
    cleaning,
    features,
    forecasts,
    graphs,
    panels,
    reports,
    sequences,
    storage,
    texts,
)
from eventcast.catalog.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
