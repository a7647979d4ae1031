"""Exact percentiles per group by distributed multi-select.

Every group and percentile seeks two neighbouring ranks. In a round each part of the data proposes the median of its values
still in question with their weight, the weighted median of the proposals becomes the pivot, counts are taken three ways
(below, equal, above) and the ranks decide which side survives. The rest is discarded, so passes shrink by about half, until
a target has at most HANDFUL values, of which its two ranks are read. Every group goes through the rounds, whatever its
size; the error is 0 whatever the order or number of the parts.

Input is folded to (group, value, count) first. These tables are the mergeable form: union those of several days, months or
partitions and select again for the percentiles of all of them together.

Scale: counts combine before the shuffle, proposals are one row per task and group, no group is ever sorted whole, and a
group of many values meets its pivot in parts of about PART_VALUES values, by their hash. The rounds are about the binary
logarithm of the most distinct values, and each reads half of the one before.

Defined results: null, NaN and infinite values are the caller's to leave out (they are dropped here); groups without values
have no row; percentiles interpolate linearly between neighbouring values; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skygrain.functions.exprs import finite
from skygrain.sources.scratch import exists, new_path, written

#: Values left at which a target ends (two, and what weights may leave beside them), and values of a part of a target.
HANDFUL, PART_VALUES, MAX_ROUNDS = 4, 1_000_000, 200


def counts(df: DataFrame, groups: list[str], value: Column) -> DataFrame:
    """(groups, value, n): mergeable value counts of the finite values."""
    return df.select(*groups, value.cast("double").alias("value")).filter(finite(F.col("value"))).groupBy(*groups, "value").agg(F.count("*").alias("n"))


def merged(tables: list[DataFrame], groups: list[str]) -> DataFrame:
    """Value counts of several parts as one, grouped by `groups` (any of their group columns)."""
    every = tables[0].select(*groups, "value", "n")
    for t in tables[1:]:
        every = every.unionByName(t.select(*groups, "value", "n"))
    return every.groupBy(*groups, "value").agg(F.sum("n").alias("n"))


def _weighted_median(values: np.ndarray, weights: np.ndarray) -> float:
    order = np.argsort(values)
    total = np.cumsum(weights[order])
    return float(values[order][np.searchsorted(total, total[-1] / 2)])


def _propose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of one part of the data: per target the median and weight; medians of its batches fold at the end."""
    found: dict[tuple[int, int], list[tuple[float, float]]] = {}
    fold = lambda parts: (_weighted_median(*np.array(parts).T), sum(w for _, w in parts))
    for pdf in batches:
        for target, some in pdf.groupby(["target", "parts"], sort=False):
            w = some["n"].to_numpy(float)
            mine = found.setdefault(target, [])
            mine.append((_weighted_median(some["value"].to_numpy(), w), w.sum()))
            if len(mine) >= 64:
                found[target] = [fold(mine)]
    yield pd.DataFrame([(*target, *fold(some)) for target, some in found.items()], columns=["target", "parts", "value", "weight"])


def _pivots(live: DataFrame) -> DataFrame:
    """(target, parts, pivot): weighted medians of the parts' proposals."""
    proposals = live.select("target", "parts", "value", "n").mapInPandas(_propose, "target long, parts long, value double, weight double")
    upto = Window.partitionBy("target").orderBy("value", "weight").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy("target")
    half = proposals.withColumns({"upto": F.sum("weight").over(upto), "total": F.sum("weight").over(every)}).filter("upto >= total / 2")
    return half.groupBy("target").agg(F.max("parts").alias("parts"), F.min("value").alias("pivot"))


def _spread(targets: DataFrame) -> DataFrame:
    """targets once per part of theirs: a target of many values meets its rows in many tasks."""
    return targets.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")


def _parts(left) -> Column:
    return F.ceil(F.greatest(F.lit(1), left) / PART_VALUES).cast("long")


def _part(value: Column, parts: Column) -> Column:
    return F.pmod(F.xxhash64(value), parts)


LIVE = "target long, part long, parts long, rank double, low long, value double, n long"


def _round(live: DataFrame) -> DataFrame:
    """The values that are still in question after a pivot of each target; `ends` marks targets with a handful left."""
    v, pivot = F.col("value"), F.col("pivot")
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    three = live.join(_spread(_pivots(live)), ["target", "part"]).groupBy("target", "parts", "rank", "low", "pivot").agg(
        total(v < pivot).alias("below"), total(v == pivot).alias("equal"), F.count_if(v < pivot).alias("n_below"), F.count_if(v > pivot).alias("n_above")
    )
    under, low, high = F.col("low") + F.col("below"), F.floor("rank"), F.ceil("rank")
    upto = under + F.col("equal")
    # The pivot is a value of its target: both ranks are the pivot's, or lie up to it, or from it. Beside another value it stays
    # with the one copy that a rank may need, so a value of more than half the weight can't stop the search.
    sides = three.withColumn("side", F.when((low >= under) & (high < upto), 0).when(high < upto, -1).otherwise(1))
    at, down = F.col("side") == 0, F.col("side") == -1
    keep = F.when(at, F.col("equal")).when(down, F.greatest(F.lit(0), high + 1 - under)).otherwise(F.greatest(F.lit(0), upto - low))
    left = F.when(at, 1).when(down, F.col("n_below") + 1).otherwise(F.col("n_above") + 1)
    sides = sides.withColumns({"keep": keep, "left": left})
    new_low = F.when(at, under).when(down, F.col("low")).otherwise(upto - F.col("keep"))
    sides = sides.select("target", "parts", "pivot", "side", "keep", new_low.alias("low"), _parts(F.col("left")).alias("new_parts"), (F.col("left") <= HANDFUL).alias("ends"))
    # The old parts meet the rows as they are, the new ones follow from the values left.
    kept = live.drop("low", "parts").join(_spread(sides), ["target", "part"]).filter("case side when 0 then value = pivot when -1 then value <= pivot else value >= pivot end")
    kept = kept.withColumn("n", F.when(v == pivot, F.col("keep")).otherwise(F.col("n"))).filter("n > 0")
    return kept.select("target", _part(v, F.col("new_parts")).alias("part"), F.col("new_parts").alias("parts"), "rank", "low", "value", "n", "ends")


def select(table: DataFrame, groups: list[str], percentiles: list[float]) -> DataFrame:
    """(groups, p, value, n): the exact percentile `p` of each group's value counts, linearly interpolated."""
    if not percentiles or not all(0 <= p <= 1 for p in percentiles):
        raise ValueError("percentiles lie between 0 and 1")
    spark, given = table.sparkSession, groups
    table = table.select(*groups, "value", "n")
    if not groups:
        table, groups = table.withColumn("_all", F.lit(True)), ["_all"]
    table = written(table, "counts")
    sizes = table.groupBy(*groups).agg(F.sum("n").alias("size"), F.count("*").alias("left"))
    ps = F.explode(F.array(*map(F.lit, percentiles))).alias("p")
    targets = sizes.select(*groups, "size", "left", ps).withColumn("rank", F.col("p") * (F.col("size") - 1))
    # A target is a group and a percentile; its id is a hash of both, checked to be unique.
    targets = written(targets.withColumns({"target": F.xxhash64(*groups, "p"), "parts": _parts(F.col("left"))}), "targets")
    seen = targets.agg(F.count("*"), F.count_distinct("target")).first()
    if seen[0] != seen[1]:
        raise ValueError("hash collision between groups")
    if not seen[0]:
        return targets.select(*given, "p", F.lit(None).cast("double").alias("value"), F.col("size").alias("n"))
    on = F.lit(True)
    for g in groups:
        on = on & F.col(f"t.{g}").eqNullSafe(F.col(f"v.{g}"))
    # `low` values lie under those still in question; a part of a target is a share of its values.
    start = table.alias("v").join(targets.select(*groups, "target", "parts", "rank").alias("t"), on)
    live = written(start.select("target", _part(F.col("value"), F.col("parts")).alias("part"), "parts", "rank", F.lit(0).cast("long").alias("low"), "value", "n"), "live-0")
    ended: list[str] = []
    for k in range(1, MAX_ROUNDS + 1):
        path = new_path(spark, f"live-{k}")
        _round(live).write.partitionBy("ends").parquet(path)
        if exists(spark, f"{path}/ends=true"):
            ended.append(f"{path}/ends=true")
        if not exists(spark, f"{path}/ends=false"):
            break
        live = spark.read.schema(LIVE).parquet(f"{path}/ends=false")
    else:
        raise RuntimeError(f"selection did not end in {MAX_ROUNDS} rounds")
    values = _placed(spark.read.schema(LIVE).parquet(*ended))
    return targets.drop("rank").join(values, "target").select(*given, "p", "value", F.col("size").alias("n"))


def _placed(last: DataFrame) -> DataFrame:
    """(target, value) from the handful of values that each target is left with."""
    placed = last.withColumn("end", F.col("low") + F.sum("n").over(Window.partitionBy("target").orderBy("value")))
    at = lambda r: F.min(F.when(F.col("end") > r, F.col("value")))
    found = placed.groupBy("target", "rank").agg(at(F.floor("rank")).alias("a"), at(F.ceil("rank")).alias("b"))
    return found.select("target", (F.col("a") + (F.col("b") - F.col("a")) * (F.col("rank") - F.floor("rank"))).alias("value"))
