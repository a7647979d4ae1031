"""Space-time blocks, baselines and metrics."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType
from pyspark.sql.window import Window

from skygrain.functions.exprs import finite, hours
from skygrain.functions.prefix import running_total
from skygrain.operators.stats import melted, percentiles


def time_blocks(df: DataFrame, time: str, k: int) -> DataFrame:
    """(time, time_block): contiguous blocks of the distinct times, floor((rank - 1) k / n). One row per distinct time."""
    t = df.filter(F.col(time).isNotNull()).select(time).distinct()
    at = F.col(time) if isinstance(t.schema[time].dataType, NumericType) else hours(F.col(time))
    numbered = running_total(t, [], F.floor(at / 1024), [time], F.lit(1).cast("long"), "_i")
    n = t.agg(F.count("*").alias("_n"))
    return numbered.join(F.broadcast(n)).select(time, F.floor(F.col("_i") * k / F.col("_n")).cast("long").alias("time_block"))  # one row


def space_blocks(places: DataFrame, lat: str, lon: str, k: int, seeds: int = 5, seed: int = 20) -> DataFrame:
    """places with `space_block`: k-means of unit vectors over distinct places, the best of several seeds."""
    la, lo = F.radians(lat), F.radians(lon)
    p = places.select(lat, lon).distinct().withColumn("_v", array_to_vector(F.array(F.cos(la) * F.cos(lo), F.cos(la) * F.sin(lo), F.sin(la))))
    fits = [KMeans(k=k, seed=seed + i, featuresCol="_v", predictionCol="space_block").fit(p) for i in range(seeds)]
    return min(fits, key=lambda m: m.summary.trainingCost).transform(p).drop("_v")


def fold_sums(df: DataFrame, space: str, time: str, measures: dict[str, Column]) -> DataFrame:
    """Per fold (space, time): each measure summed over its test rows and over its training rows.

    Training rows are in neither the fold's space block nor its time block, so their sum is total - space - time + both:
    one pass over the rows whatever the number of folds.
    """
    names = list(measures)
    g = df.groupBy(space, time).agg(*[F.sum(m).alias(n) for n, m in measures.items()])
    s, t, a = Window.partitionBy(space), Window.partitionBy(time), Window.partitionBy(F.lit(0))
    total = lambda n, w: F.coalesce(F.sum(n).over(w), F.lit(0))
    return g.select(space, time, *[F.col(n).alias(f"test_{n}") for n in names], *[(total(n, a) - total(n, s) - total(n, t) + F.coalesce(F.col(n), F.lit(0))).alias(f"train_{n}") for n in names])


def metrics(y: Column, p: Column) -> list[Column]:
    """rmse, mae and r2 of an aggregate; r2 is null for under two rows or a constant y."""
    e = y - p
    varies = (F.count(y) >= 2) & (F.max(y) > F.min(y))
    spread = F.sum(y * y) - F.sum(y) * F.sum(y) / F.count(y)
    return [F.count(y).alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.when(varies, 1 - F.sum(e * e) / F.when(varies, spread)).alias("r2")]


def medians(train: DataFrame, columns: list[str]) -> DataFrame:
    """One row of exact medians, non-finite values left out; 0 for a column without values."""
    m = percentiles(melted(train, [], columns), ["variable"], "value", {"m": 0.5})
    return m.agg(*[F.coalesce(F.max(F.when(F.col("variable") == c, F.col("m"))), F.lit(0.0)).alias(f"_m_{c}") for c in columns])


def imputed(df: DataFrame, fill: DataFrame, columns: list[str]) -> DataFrame:
    """Non-finite values replaced by the fill row's medians."""
    ok = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) != float("inf"))
    return df.join(F.broadcast(fill)).withColumns({c: F.when(ok(c), F.col(c).cast("double")).otherwise(F.col(f"_m_{c}")) for c in columns}).drop(*[f"_m_{c}" for c in columns])  # one row


def _code(column: str) -> Column:
    """A code as a whole number, -1 where it is missing."""
    x = F.col(column)
    return F.when(finite(x), x.cast("long")).otherwise(F.lit(-1))


def codes_of(train: DataFrame, column: str, most: int = 256) -> list[int]:
    """The codes of a categorical column in the training rows, -1 among them if some are missing; more than `most` are an error."""
    got = sorted(r[0] for r in train.select(_code(column)).distinct().limit(most + 1).collect())
    if len(got) > most:
        raise ValueError(f"{column} has more than {most} codes")
    return got


def onehot(df: DataFrame, column: str, codes: list[int]) -> DataFrame:
    """0/1 columns <column>_<code> for the codes seen in training, <column>_missing for -1; other values have none."""
    return df.withColumns({f"{column}_{'missing' if k == -1 else k}": (_code(column) == k).cast("double") for k in codes})
