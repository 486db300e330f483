"""What several operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import DataFrame

from lumora.operators.joins import bounded_broadcast, spread_join

__all__ = ["bounded_broadcast", "bounded_rows", "spread_join"]


def bounded_rows(df: DataFrame, limit: int, what: str) -> list:
    """The rows of a table that has to be small, or an error if it isn't."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what} has over {limit} rows")
    return rows
