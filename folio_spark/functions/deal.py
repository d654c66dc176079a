"""Partitions whose size does not grow with the table."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Rows of a partition, about.
ROWS = 500_000


def parts_for(df: DataFrame, rows: int = ROWS) -> int:
    """Partitions of about ``rows`` rows each, no fewer than the session has cores."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))


def dealt(df: DataFrame, *keys: str, parts: int | None = None) -> DataFrame:
    """Rows of a key together, in a number of partitions that follows the row count.

    Left to its compressed bytes a shuffle gives well packed rows to a few tasks, which then sort tens of millions each.
    """
    return df.repartition(parts or parts_for(df), *keys)
