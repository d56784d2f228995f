"""Shuffles whose tasks do not grow with the table."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Rows that a task sorts or aggregates at most, on average.
ROWS_A_TASK = 500_000


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """`df`, of some `rows` rows, by keys over as many tasks as they need, at least the session's shuffle partitions.
    Joins, groups and windows by these keys then need no shuffle of their own."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-rows // ROWS_A_TASK)), *keys)
