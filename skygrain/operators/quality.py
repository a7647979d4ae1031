"""Quality filters, rejection and retention reports, deduplication, coverage of days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skygrain.functions.exprs import finite

LOW, HIGH = 0.0, 500.0


def in_range(value: Column, low: float = LOW, high: float = HIGH) -> Column:
    """Finite and within (low, high]: NaN compares above every number, so the finite test is explicit."""
    return finite(value) & (value > low) & (value <= high)


def some(df: DataFrame, what: str) -> DataFrame:
    """df, which must have rows."""
    if df.isEmpty():
        raise ValueError(f"no rows: {what}")
    return df


def rejections(df: DataFrame, value: Column, low: float = LOW, high: float = HIGH) -> DataFrame:
    """(reason, n_rows): one reason per rejected row; a null value is non-finite."""
    ok = finite(value)
    one = df.agg(F.count_if(~ok).alias("a"), F.count_if(ok & (value <= low)).alias("b"), F.count_if(ok & (value > high)).alias("c"))
    return one.selectExpr("stack(3, 'nonfinite', a, 'at_or_below_min', b, 'above_max', c) as (reason, n_rows)")


def retention(df: DataFrame, steps: dict[str, Column]) -> DataFrame:
    """(step, n_rows, fraction_of_loaded): rows left after each step and all before it, in one pass."""
    upto, counts = F.lit(True), [F.count("*").alias("loaded")]
    for name, keep in steps.items():
        upto = upto & F.coalesce(keep, F.lit(False))
        counts.append(F.count_if(upto).alias(name))
    names = ["loaded", *steps]
    one = df.agg(*counts)
    rows = one.selectExpr("loaded as n_loaded", f"stack({len(names)}, {', '.join(f'\'{n}\', `{n}`' for n in names)}) as (step, n_rows)")
    return rows.select("step", "n_rows", F.when(F.col("n_loaded") > 0, F.col("n_rows") / F.col("n_loaded")).alias("fraction_of_loaded"))


def first_of(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order. min_by over a struct combines before the shuffle, a window wouldn't."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*keys, "_row.*")


def conflicts(df: DataFrame, keys: list[str], value: str, rtol: float = 0.01, atol: float = 1.0) -> DataFrame:
    """Keys whose repeated values differ by more than the larger of `atol` and `rtol` of their mean."""
    g = df.filter(finite(F.col(value))).groupBy(*keys).agg(F.count("*").alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"), F.avg(value).alias("mean"))
    return g.filter((F.col("n") > 1) & (F.col("hi") - F.col("lo") > F.greatest(F.lit(atol), rtol * F.abs("mean")))).select(*keys, "n", "lo", "hi")


def calendar(df: DataFrame, day: str, step: str = "1 day") -> DataFrame:
    """All days (or months) from the first to the last of `day`, from one row."""
    ends = df.agg(F.min(day).alias("a"), F.max(day).alias("b")).filter("a is not null")
    return ends.select(F.explode(F.expr(f"sequence(a, b, interval {step})")).alias(day))


def coverage(days: DataFrame, group: str, day: str) -> DataFrame:
    """Per group every day from its first to its last: n_olr, n_geolocated, n_earth_view, n_valid and the first status that holds.

    `days` has these counts and `dead` (nothing but zeros) for the days with rows.
    """
    every = days.groupBy(group).agg(F.explode(F.sequence(F.min(day), F.max(day))).alias(day))
    out = every.join(days, [group, day], "left").fillna(0).fillna({"dead": False})
    status = F.when(F.col("dead"), "dead_olr")
    for count, name in (("n_olr", "no_olr"), ("n_geolocated", "no_geolocation"), ("n_earth_view", "no_earth_view"), ("n_valid", "gap_too_large")):
        status = status.when(F.col(count) == 0, name)
    return out.withColumn("status", status.otherwise("ok")).drop("dead")


def dead_groups(df: DataFrame, group: str, value: str, least: int = 1000) -> DataFrame:
    """Groups of under `least` rows that hold zeros only."""
    g = df.groupBy(group).agg(F.count("*").alias("n_rows"), F.coalesce(F.bool_and(F.col(value) == 0), F.lit(False)).alias("zeros"))
    return g.filter((F.col("n_rows") < least) & F.col("zeros")).select(group, "n_rows")
