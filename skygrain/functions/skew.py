"""Joins whose left side may hold a third of all rows under one key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a key beyond which its rows aren't shuffled; at most (all rows / HOT_ROWS) keys are broadcast.
HOT_ROWS = 1_000_000


def join_hot(df: DataFrame, table: DataFrame, on: list[str], rows: str) -> DataFrame:
    """df joined with `table`, which has one row per key and in `rows` how many rows of df the key has.

    Rows of outgrown keys stay where they are and meet a broadcast of those keys, the others are shuffled. `rows` is dropped;
    null keys match nothing.
    """
    hot = table.filter(F.col(rows) > HOT_ROWS).drop(rows)
    if hot.isEmpty():
        return df.join(table.drop(rows), on)
    cold = df.join(F.broadcast(hot.select(*on)), on, "left_anti").join(table.filter(F.col(rows) <= HOT_ROWS).drop(rows), on)
    return cold.unionByName(df.join(F.broadcast(hot), on))
