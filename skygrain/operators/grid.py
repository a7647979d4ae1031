"""Snapping to grids, hourly cell means and joins that keep the grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skygrain.functions.exprs import finite_or_null


def cell_index(x: Column, start: float, step: float) -> Column:
    """Index of the nearest value of a regular grid; halves go to the even index, as in IEEE rounding."""
    return F.rint((x.cast("double") - start) / step).cast("long")


def nearest_value(x: Column, grid: list[float]) -> Column:
    """Nearest of an irregular ascending grid; ties go to the lower value, outside values to the ends."""
    return F.array_min(F.transform(F.array(*[F.lit(float(g)) for g in grid]), lambda g: F.struct(F.abs(g - x).alias("d"), g.alias("g"))))["g"]


def wrapped_index(lon: Column, first: float, step: float) -> Column:
    """Index on a global longitude grid: the last cell and the first are neighbours."""
    n = round(360 / step)
    return F.pmod(F.rint(F.pmod(lon.cast("double") - first, F.lit(360.0)) / step).cast("long"), F.lit(n).cast("long"))


def axes(lat: tuple[float, float, float], lon: tuple[float, float, float]) -> Column:
    """Array of (latitude, longitude) of a regular grid, longitude fastest: a bounded literal, not a join."""
    seq = lambda a, b, s: F.transform(F.sequence(F.lit(0), F.lit(round((b - a) / s))), lambda i: F.lit(a) + i * F.lit(s))
    return F.flatten(F.transform(seq(*lat), lambda y: F.transform(seq(*lon), lambda x: F.struct(y.alias("latitude"), x.alias("longitude")))))


def hourly_mean(df: DataFrame, keys: list[str], value: str, names: tuple[str, str] = ("mean", "n")) -> DataFrame:
    """Mean and count of the finite values per key; cells without any are absent."""
    v = finite_or_null(F.col(value).cast("double"))
    return df.groupBy(*keys).agg(F.avg(v).alias(names[0]), F.count(v).alias(names[1])).filter(F.col(names[1]) > 0)


def grid_left(grid: DataFrame, means: DataFrame, keys: list[str], count: str) -> DataFrame:
    """Every grid row with the mean of its cell, if any; the count is 0 where there is none."""
    return grid.join(means, keys, "left").withColumn(count, F.coalesce(count, F.lit(0)))


def circular_mean(x: Column, turn: float) -> Column:
    """Mean on a circle of `turn` units, in [0, turn)."""
    a = x * F.lit(2 * 3.141592653589793 / turn)
    return F.pmod(F.atan2(F.avg(F.sin(a)), F.avg(F.cos(a))) * F.lit(turn / (2 * 3.141592653589793)), F.lit(turn))
