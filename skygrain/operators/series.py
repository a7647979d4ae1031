"""Time series: buckets, regular indices, lag autocorrelation, trends, bracketing of one clock by another."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skygrain.functions.exprs import finite, micros
from skygrain.operators.stats import percentiles


def bucket(t: Column, rule: str) -> Column:
    """Date that names the bucket of a time: its day, the Monday that ends its week (Tue to Mon), its month or year."""
    d = t.cast("date")
    if rule == "week":
        return F.date_add(F.trunc(F.date_sub(d, 1), "week"), 7)
    return {"day": d, "month": F.trunc(d, "month"), "year": F.trunc(d, "year")}[rule]


def resample(df: DataFrame, time: str, value: str, rule: str) -> DataFrame:
    """(period_start, n, mean, median, std) for every bucket from the first to the last, empty ones with nulls."""
    rows = df.select(bucket(F.col(time), rule).alias("period_start"), value)
    g = rows.groupBy("period_start").agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
    middle = percentiles(rows, ["period_start"], value, {"median": 0.5})
    ends = g.agg(F.min("period_start").alias("a"), F.max("period_start").alias("b")).filter("a is not null")
    every = ends.select(F.explode(F.expr(f"sequence(a, b, interval 1 {rule})")).alias("period_start"))
    return every.join(g, "period_start", "left").join(middle, "period_start", "left").fillna(0, ["n"])


def autocorrelation(series: DataFrame, index: str, value: str, lags: int, keys: list[str] = (), least: int = 6) -> DataFrame:
    """(keys, lag, n_pairs, autocorrelation, band) of a series on whole-number positions from lag 0, gaps left out pairwise.

    All lags share one join: each position is sent to the positions `lag` later. NULL below `least` pairs or where a side is
    constant.
    """
    keys = list(keys)
    s = series.filter(finite(F.col(value))).select(*keys, F.col(index).alias("_i"), F.col(value).cast("double").alias("_x"))
    sent = s.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(lags))).alias("lag"), "_i", F.col("_x").alias("_y")).withColumn("_i", F.col("_i") + F.col("lag"))
    pairs = s.join(sent, [*keys, "_i"])
    g = pairs.groupBy(*keys, "lag").agg(
        F.count("*").alias("n_pairs"), F.covar_pop("_x", "_y").alias("c"), F.stddev_pop("_x").alias("sx"), F.stddev_pop("_y").alias("sy"), F.min("_x").alias("x0"), F.max("_x").alias("x1"), F.min("_y").alias("y0"), F.max("_y").alias("y1")
    )
    ok = (F.col("n_pairs") >= least) & (F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0"))
    return g.select(*keys, F.col("lag").cast("long").alias("lag"), "n_pairs", F.when(ok, F.col("c") / (F.col("sx") * F.col("sy"))).alias("autocorrelation"), F.when(ok, 1.96 / F.sqrt("n_pairs")).alias("band"))


def trend(df: DataFrame, x: Column, y: Column) -> DataFrame:
    """One row: n, slope, intercept, r2 of a straight line, from one aggregate."""
    return df.select(x.alias("x"), y.alias("y")).agg(F.count("*").alias("n"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.regr_r2("y", "x").alias("r2"))


def polynomial(df: DataFrame, x: Column, y: Column, degree: int) -> dict:
    """Least squares of a polynomial from power sums of one aggregate: n, coefficients (constant first), r2; null r2 if y is constant."""
    mid = df.agg(F.avg(x)).first()[0] or 0.0
    z = df.select((x - mid).alias("z"), y.alias("y"))
    powers = [F.sum(F.pow("z", F.lit(k))).alias(f"p{k}") for k in range(2 * degree + 1)]
    r = z.agg(F.count("*").alias("n"), F.sum(F.col("y") * F.col("y")).alias("yy"), *powers, *[F.sum(F.pow("z", F.lit(k)) * F.col("y")).alias(f"m{k}") for k in range(degree + 1)]).first()
    if r["n"] <= degree:
        raise ValueError(f"{r['n']} points are too few for degree {degree}")
    a = np.array([[r[f"p{i + j}"] for j in range(degree + 1)] for i in range(degree + 1)])
    b = np.array([r[f"m{i}"] for i in range(degree + 1)])
    c = np.linalg.solve(a, b)
    spread = r["yy"] - r["m0"] ** 2 / r["n"]
    # Around zero again: the polynomial of x, not of x - mid.
    out = np.polynomial.Polynomial(c)(np.polynomial.Polynomial([-mid, 1.0])).coef
    return {"n": r["n"], "coefficients": [float(v) for v in np.r_[out, np.zeros(degree + 1 - len(out))]], "r2": float(1 - (r["yy"] - c @ b) / spread) if spread > 0 else None}


def evaluated(coefficients: list[float], x: Column) -> Column:
    out = F.lit(0.0)
    for c in reversed(coefficients):
        out = out * x + F.lit(c)
    return out


def bracketed(samples: DataFrame, track: DataFrame, entity: str, time: str, key: str, values: list[str], slice_s: int = 3600) -> DataFrame:
    """samples with the track rows before (or at) and after (or at) them: <v>_before, <v>_after, t_before, t_after (microseconds).

    Both clocks are merged per (entity, slice of time), so no entity is sorted whole. A slice also gets the last track row
    before it and the first after it, however far they are, from a small table of the slices' ends. Equal track times keep
    the row with the smallest `key`.
    """
    w = slice_s * 1_000_000
    at = lambda t: F.floor(t / w).cast("long")
    s = samples.withColumns({"_t": micros(F.col(time)), "_side": F.lit(1)}).withColumn("_slice", at(F.col("_t")))
    k = track.filter(F.col(time).isNotNull() & F.col(entity).isNotNull()).groupBy(entity, micros(F.col(time)).alias("_t")).agg(F.min_by(F.struct(*values), F.col(key)).alias("_v"))
    k = k.withColumn("_slice", at(F.col("_t")))
    fix = F.struct(F.col("_t").alias("t"), F.col("_v").alias("v"))
    ends = k.groupBy(entity, "_slice").agg(F.min_by(fix, "_t").alias("first"), F.max_by(fix, "_t").alias("last"))
    slices = s.select(entity, "_slice").distinct().join(ends, [entity, "_slice"], "full")
    # One row per entity and slice: as long as the record has slices.
    one = Window.partitionBy(entity).orderBy("_slice")
    around = slices.select(
        entity, "_slice", F.last("last", True).over(one.rowsBetween(Window.unboundedPreceding, -1)).alias("a"), F.first("first", True).over(one.rowsBetween(1, Window.unboundedFollowing)).alias("b")
    )
    far = around.select(entity, "_slice", F.explode(F.array_compact(F.array("a", "b"))).alias("f")).select(entity, "_slice", F.col("f.t").alias("_t"), F.col("f.v").alias("_v"))
    both = s.unionByName(k.unionByName(far).withColumn("_side", F.lit(0)), allowMissingColumns=True)
    mark = F.when(F.col("_side") == 0, fix)
    back = Window.partitionBy(entity, "_slice").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(entity, "_slice").orderBy(F.col("_t").desc(), "_side").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumns({"_b": F.last(mark, True).over(back), "_a": F.last(mark, True).over(ahead)}).filter("_side = 1")
    cols = [F.col("_b.t").alias("t_before"), F.col("_a.t").alias("t_after"), F.col("_t").alias("t")]
    for v in values:
        cols += [F.col(f"_b.v.{v}").alias(f"{v}_before"), F.col(f"_a.v.{v}").alias(f"{v}_after")]
    return out.select(*samples.columns, *cols)


def gap(b: DataFrame) -> Column:
    """Microseconds to the nearer track row of a bracket, null outside the track."""
    return F.when(F.col("t_before").isNotNull() & F.col("t_after").isNotNull(), F.least(F.col("t") - F.col("t_before"), F.col("t_after") - F.col("t")))


def interpolated(b: DataFrame, values: list[str], reach_us: int | None = None) -> DataFrame:
    """Linear interpolation of bracketed values; null outside the track or if the nearer track row is beyond `reach_us`."""
    span = F.col("t_after") - F.col("t_before")
    share = F.when(span > 0, (F.col("t") - F.col("t_before")) / span).otherwise(F.when(span == 0, 0.0))
    if reach_us is not None:
        share = F.when(gap(b) <= reach_us, share)
    return b.withColumns({v: F.col(f"{v}_before") + (F.col(f"{v}_after") - F.col(f"{v}_before")) * share for v in values})
