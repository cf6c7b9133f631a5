"""Broadcast only behind a size check.

``bounded_broadcast`` counts at most ``max_rows + 1`` rows of the small side
(a bounded, cheap job) and hints a broadcast only when the side is within the
bound. Beyond it the plan is left to the optimizer and AQE (sort-merge or
shuffled hash join), so a side that grows with the data never lands whole on
every executor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_MAX_ROWS = 1_000_000


def row_count_at_most(df: DataFrame, max_rows: int) -> int:
    """``min(count(df), max_rows + 1)`` without counting past the bound."""
    return df.limit(max_rows + 1).count()


def bounded_broadcast(df: DataFrame, max_rows: int = DEFAULT_MAX_ROWS) -> tuple[DataFrame, bool]:
    """Return ``(df_or_broadcast_df, broadcasted)``."""
    if row_count_at_most(df, max_rows) <= max_rows:
        return F.broadcast(df), True
    return df, False
