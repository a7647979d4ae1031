"""Running totals over groups too large for one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def running_total(df: DataFrame, keys: list[str], chunk: Column, order: list[str], value: Column, name: str) -> DataFrame:
    """df with `name`: the sum of `value` over the rows of its group that come before it.

    Rows are ordered by (chunk, *order). Chunks sum in a partial aggregation, a window over the few chunks gives each its
    offset, and a window within the chunk does the rest, so no task sees a whole group. df is evaluated twice.
    """
    df = df.withColumns({"_chunk": chunk, "_value": value})
    sums = df.groupBy(*keys, "_chunk").agg(F.sum("_value").alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("_offset", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = df.join(offsets, [*keys, "_chunk"]).withColumn(name, F.col("_offset") + F.coalesce(F.sum("_value").over(inside), F.lit(0)))
    return out.drop("_chunk", "_value", "_offset")
