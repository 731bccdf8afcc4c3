"""Joins whose small side is broadcast only where its size is known to be small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a side that are broadcast at most; beyond it the join is left to a shuffle.
BROADCAST_ROWS = 1_000_000


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast if it has few rows; rows: its counted number of rows."""
    return F.broadcast(df) if rows <= limit else df
