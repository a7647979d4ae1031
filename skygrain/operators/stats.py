"""Distributions, missingness, correlation, ranks, sampled pairs, variograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skygrain.functions import skew
from skygrain.functions.exprs import finite, haversine_km
from skygrain.functions.prefix import running_total
from skygrain.sources.scratch import written

#: Parts between quantiles into which ranks cut a group of more than STRETCH_VALUES distinct values.
STRETCHES, STRETCH_VALUES = 128, 200_000


def melted(df: DataFrame, keys: list[str], columns: list[str], variable: str = "variable", value: str = "value") -> DataFrame:
    """(keys, variable, value): non-finite values become null once, here."""
    parts = [F.struct(F.lit(c).alias(variable), F.when(finite(F.col(c)), F.col(c).cast("double")).alias(value)) for c in columns]
    return df.select(*keys, F.explode(F.array(*parts)).alias("_p")).select(*keys, f"_p.{variable}", f"_p.{value}")


def distribution(long: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Counts, rates, range and moments per key, from sums that combine before the shuffle."""
    v, n = F.col(value), F.count(value)
    return long.groupBy(*keys).agg(
        F.count("*").alias("n_rows"), (F.count("*") - n).alias("n_missing"), F.count_if(v == 0).alias("n_zero"), F.count_if(v < 0).alias("n_negative"), F.count_if(v > 0).alias("n_positive"),
        F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
    )


def missingness(long: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    return long.groupBy(*keys, "variable").agg(F.count("*").alias("n_rows"), F.count_if(F.col(value).isNull()).alias("n_missing"))


def _cumulative(counts: DataFrame, keys: list[str], value: str, most: int) -> DataFrame:
    """Written value counts (keys, value, _c) with `_below`, the rows of the group that have a smaller value, and `_n`, all of them.

    Groups of up to STRETCH_VALUES distinct values (`most` is the most of any) are summed in a window each. Larger ones are
    cut into stretches between quantiles of their values, so a group of many values is many tasks' work.
    """
    if most <= STRETCH_VALUES:
        own = Window.partitionBy(*keys)
        below = F.coalesce(F.sum("_c").over(own.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return counts.withColumns({"_below": below, "_n": F.sum("_c").over(own)})
    cuts = counts.groupBy(*keys).agg(
        F.percentile_approx(value, F.array(*[F.lit(i / STRETCHES) for i in range(1, STRETCHES)]), 10 * STRETCHES).alias("_cuts"), F.sum("_c").alias("_n")
    )
    cut = counts.join(cuts, keys).withColumn("_stretch", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts")
    return running_total(cut, keys, F.col("_stretch"), [value], F.col("_c"), "_below").drop("_stretch")


def _value_counts(df: DataFrame, keys: list[str], value: str) -> tuple[DataFrame, int, int]:
    """(counts of distinct values, the most distinct values of a group, the most rows of a value)."""
    counts = written(df.groupBy(*keys, value).agg(F.count("*").alias("_c")), "value-counts")
    most = counts.groupBy(*keys).agg(F.count("*").alias("d"), F.max("_c").alias("c")).agg(F.max("d"), F.max("c")).first()
    return counts, most[0] or 0, most[1] or 0


def ranked(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Average ranks from counts of distinct values, null values left out; rows of a frequent value aren't shuffled by it."""
    counts, most, often = _value_counts(df.filter(F.col(value).isNotNull()), keys, value)
    ranks = _cumulative(counts, keys, value, most).select(*keys, value, (F.col("_below") + (F.col("_c") + 1) / 2).alias(name), "_c")
    if often <= skew.HOT_ROWS:
        return df.join(ranks.drop("_c"), [*keys, value])
    return skew.join_hot(df, written(ranks, "ranks"), [*keys, value], "_c")


def percentiles(df: DataFrame, keys: list[str], value: str, ps: dict[str, float]) -> DataFrame:
    """(keys, names of ps): exact percentiles of the finite values, linearly interpolated, from counts of distinct values.

    No task holds a large group's values, unlike the built-in aggregates. Groups without finite values have no row. Key
    columns must have no nulls.
    """
    given = list(keys)
    rows = df.filter(finite(F.col(value))).select(*given, F.col(value).cast("double").alias("_x"))
    keys = given or ["_all"]
    if not given:
        rows = rows.withColumn("_all", F.lit(True))
    counts, most, _ = _value_counts(rows, keys, "_x")
    placed = _cumulative(counts, keys, "_x", most)
    at = lambda rank: F.max(F.when((F.col("_below") <= rank) & (rank < F.col("_below") + F.col("_c")), F.col("_x")))
    parts = []
    for i, p in enumerate(ps.values()):
        rank = F.lit(float(p)) * (F.col("_n") - 1)
        parts += [at(F.floor(rank)).alias(f"_a{i}"), at(F.ceil(rank)).alias(f"_b{i}")]
    g = placed.groupBy(*keys).agg(F.max("_n").alias("_n"), *parts)
    rest = lambda p: F.lit(float(p)) * (F.col("_n") - 1) - F.floor(F.lit(float(p)) * (F.col("_n") - 1))
    return g.select(*given, *[(F.col(f"_a{i}") + (F.col(f"_b{i}") - F.col(f"_a{i}")) * rest(p)).alias(n) for i, (n, p) in enumerate(ps.items())])


def guarded_corr(x: str, y: str, least: int = 20) -> Column:
    """Pearson correlation of an aggregate, null below `least` pairs or for a constant side."""
    varies = (F.max(x) > F.min(x)) & (F.max(y) > F.min(y)) & (F.count("*") >= least)
    return F.when(varies, F.covar_pop(x, y) / F.when(varies, F.stddev_pop(x) * F.stddev_pop(y)))


def scrambled(key: Column) -> Column:
    """A whole number below 2^32 that scatters consecutive keys; plain arithmetic, so any engine gives the same."""
    return F.pmod(F.pmod(key, F.lit(2**31)) * F.lit(2654435761), F.lit(2**32))


def sampled_pairs(df: DataFrame, group: str, key: str, lat: str, lon: str, values: list[str], each: int = 3, bucket: int = 4096) -> DataFrame:
    """Pairs of rows of one group: each row with its next `each` rows in scrambled order, with their distance.

    A linear sample in place of all pairs. Large groups are cut into buckets by the scrambled key, so none is sorted whole.
    Columns: group, left_<key>, right_<key>, distance_km, left_<v>, right_<v>.
    """
    s = scrambled(F.col(key))
    sizes = df.groupBy(group).agg(F.ceil(F.count("*") / bucket).alias("_parts"))
    cut = df.join(sizes, group).withColumns({"_s": s, "_bucket": F.floor(s * F.col("_parts") / F.lit(2**32))})
    w = Window.partitionBy(group, "_bucket").orderBy("_s", key)
    own = F.struct(F.col(key).alias("k"), F.col(lat).alias("lat"), F.col(lon).alias("lon"), *[F.col(v).alias(v) for v in values])
    ahead = cut.withColumn("_own", own).withColumn("_next", F.array_compact(F.array(*[F.lead("_own", j).over(w) for j in range(1, each + 1)])))
    p = ahead.select(group, F.col("_own").alias("a"), F.explode("_next").alias("b"))
    cols = [F.col("a.k").alias(f"left_{key}"), F.col("b.k").alias(f"right_{key}"), haversine_km(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon")).alias("distance_km")]
    for v in values:
        cols += [F.col(f"a.{v}").alias(f"left_{v}"), F.col(f"b.{v}").alias(f"right_{v}")]
    return p.select(group, *cols)


def by_distance(pairs: DataFrame, value: str, width_km: float, bins: int, least: int = 10) -> DataFrame:
    """Per distance bin: pairs, mean distance, semivariance and Pearson correlation of the two sides."""
    left, right = f"left_{value}", f"right_{value}"
    p = pairs.filter(finite(F.col(left)) & finite(F.col(right))).withColumn("bin", F.least(F.floor(F.col("distance_km") / width_km), F.lit(bins - 1)))
    g = p.groupBy("bin").agg(F.count("*").alias("n_pairs"), F.avg("distance_km").alias("mean_distance_km"), (F.avg((F.col(left) - F.col(right)) ** 2) / 2).alias("semivariance"), guarded_corr(left, right, least).alias("correlation"))
    return g.filter(F.col("n_pairs") >= least)
