"""Joins with tables that may be small, and rows dealt to partitions that stay small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows up to which a table of ids and flags is broadcast; beyond it the join is left to the planner.
SMALL = 200_000


def bounded(df: DataFrame, rows: int = SMALL) -> DataFrame:
    """df, with a hint to broadcast it if it is counted to have `rows` rows at most."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def dealt(df: DataFrame, by: list[str], rows: int) -> DataFrame:
    """df dealt by `by` to partitions of about `rows` rows, which AQE does not merge again.

    For rows that a task makes many of: grouped by `by` and more in the same stage, they move no further and fit its memory. df is counted first, so it should be a
    table or cheap.
    """
    return df.repartition(max(1, -(-df.count() // max(1, rows))), *by)
