"""Irregular readings onto a regular time grid by a Kalman smoother with a continuous-time local trend.

State per source: level and slope; between two times dt apart the level drifts with the slope, and both take noise that
grows with dt (integrated Wiener process plus a random walk of the level). Readings and grid times are one ordered
sequence; a forward filter and a backward (Rauch-Tung-Striebel) pass give every grid time a value and a variance.

Scale: usable readings fold into one weighted reading per source and bin of `BIN_S` seconds in a partial aggregation, so a
source's calendar month is bounded by the bins of a month however many rows fall into it. Sources of a month meet in buckets
of about BUCKET_BINS bins, as many as the month's bins ask for, and numpy smooths up to SIDE_BY_SIDE of them at once, each
with a halo of the neighbouring months' readings, so that a filled value at a month's border knows both sides. Noise levels
come per source from mergeable sketches over all its readings.

Defined results: rows with null source or time are left out; a reading is usable if its value is finite and within
(low, high] and its weight is above 0; copies weigh as rows of their own; a month whose source has no usable reading has no
slots; the grid runs per source and month from the first to the last hour with a usable reading; empty in, empty out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skygrain.functions.exprs import finite, hours, micros
from skygrain.sources.scratch import written

BIN_S, HALO_H = 60, 48
BUCKET_BINS, SIDE_BY_SIDE = 25_000, 64
OUT = "source {kind}, month date, slot long, value double, std double, missing boolean, n_readings long"


def usable(value: Column, weight: Column, low: float = 0.0, high: float = 500.0) -> Column:
    return F.coalesce(finite(value) & (value > low) & (value <= high) & (weight > 0), F.lit(False))


def smooth_many(t: np.ndarray, y: np.ndarray, r: np.ndarray, q_level: np.ndarray, q_slope: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smoothed levels and their variances at times t (hours, ascending) of many series at once, one a row.

    y is NaN where there is no reading, and every row has one at least; r is a reading's variance. A shorter series is padded
    with its last time and NaN, which changes nothing before it.
    """
    t, y, r = (np.ascontiguousarray(a.T) for a in (t, y, r))  # a step is a row: all series move together
    n, k = t.shape
    row, seen = np.arange(k), ~np.isnan(y)
    at = seen.argmax(axis=0)
    m, s = y[at, row].copy(), np.zeros(k)
    c = np.nanvar(y, axis=0) + r[at, row] + 1.0
    a, b = 10 * c, np.zeros(k)
    # Filtered and predicted moments: level, slope, and the three entries of their covariance.
    filtered, predicted = np.empty((n, 5, k)), np.empty((n, 5, k))
    steps = np.diff(t, axis=0, prepend=t[:1])
    for i in range(n):
        d = steps[i]
        m = m + d * s
        a, b, c = a + 2 * d * b + d * d * c + q_level * d + q_slope * d**3 / 3, b + d * c + q_slope * d * d / 2, c + q_slope * d
        predicted[i] = m, s, a, b, c
        gain = np.where(seen[i], 1 / (a + r[i]), 0.0)
        g, h, e = a * gain, b * gain, np.where(seen[i], y[i] - m, 0.0)
        m, s = m + g * e, s + h * e
        a, b, c = (1 - g) * a, (1 - g) * b, c - h * b
        filtered[i] = m, s, a, b, c
    level, variance = np.empty((n, k)), np.empty((n, k))
    level[-1], variance[-1] = m, np.maximum(a, 0)
    for i in range(n - 2, -1, -1):
        d = steps[i + 1]
        pm, ps, A, B, C = predicted[i + 1]
        fm, fs, fa, fb, fc = filtered[i]
        det = A * C - B * B
        flat = det <= 1e-300
        inverse = 1 / np.where(flat, 1.0, det)
        # Gain = filtered covariance x transition' x inverse of the predicted covariance.
        x1, x2, x3, x4 = fa + d * fb, fb, fb + d * fc, fc
        g11, g12, g21, g22 = (x1 * C - x2 * B) * inverse, (x2 * A - x1 * B) * inverse, (x3 * C - x4 * B) * inverse, (x4 * A - x3 * B) * inverse
        em, es, da, db, dc = m - pm, s - ps, a - A, b - B, c - C
        m, s = np.where(flat, fm, fm + g11 * em + g12 * es), np.where(flat, fs, fs + g21 * em + g22 * es)
        u1, u2, w1, w2 = g11 * da + g12 * db, g11 * db + g12 * dc, g21 * da + g22 * db, g21 * db + g22 * dc
        a, b, c = np.where(flat, fa, fa + u1 * g11 + u2 * g12), np.where(flat, fb, fb + u1 * g21 + u2 * g22), np.where(flat, fc, fc + w1 * g21 + w2 * g22)
        level[i], variance[i] = m, np.maximum(a, 0)
    return level.T, variance.T


def smooth(t: np.ndarray, y: np.ndarray, r: np.ndarray, q_level: float, q_slope: float) -> tuple[np.ndarray, np.ndarray]:
    """`smooth_many` of one series."""
    level, variance = smooth_many(t[None], y[None], r[None], np.array([q_level]), np.array([q_slope]))
    return level[0], variance[0]


def _series(pdf: pd.DataFrame) -> dict | None:
    """One source's month, its readings in order: grid slots, and times, values and noise of readings and slots together."""
    own = pdf[pdf["own"].to_numpy()]
    if not len(own):
        return None
    slots = np.arange(own["slot"].min(), own["slot"].max() + 1)
    # Times in hours from the first slot keep their precision.
    t = (pdf["t"].to_numpy(np.int64) - slots[0] * 3_600_000_000) / 3.6e9
    noise, step = float(own["noise"].iloc[0]), float(own["step"].iloc[0])
    noise = noise if noise > 0 else 1e-3
    step = step if step > 0 else noise
    all_t = np.r_[t, (slots - slots[0]).astype(float)]
    order = np.argsort(all_t, kind="stable")
    back = np.empty(len(order), int)
    back[order] = np.arange(len(order))
    n = np.bincount(own["slot"].to_numpy(np.int64) - slots[0], weights=own["n"].to_numpy(float), minlength=len(slots)).astype(np.int64)
    y = np.r_[pdf["y"].to_numpy(float), np.full(len(slots), np.nan)]
    r = np.r_[noise**2 / np.maximum(pdf["w"].to_numpy(float), 1e-9), np.zeros(len(slots))]
    return {"source": own["source"].iloc[0], "slots": slots, "t": all_t[order], "y": y[order], "r": r[order], "at": back[len(t) :], "n": n, "step": step}


def _smooth_bucket(pdf: pd.DataFrame) -> pd.DataFrame:
    """Some sources of one month, smoothed side by side."""
    pdf = pdf.sort_values(["source", "t", "y"], kind="stable")
    month = pdf["month"].iloc[0]
    found = [x for _, g in pdf.groupby("source", sort=False) if (x := _series(g)) is not None]
    found.sort(key=lambda x: len(x["t"]))  # neighbours in length pad little
    parts = []
    for i in range(0, len(found), SIDE_BY_SIDE):
        some = found[i : i + SIDE_BY_SIDE]
        longest = max(len(x["t"]) for x in some)
        fill = lambda x, k, v: np.r_[x[k], np.full(longest - len(x[k]), v)]
        t, y, r = (np.array([fill(x, k, x["t"][-1] if k == "t" else v) for x in some]) for k, v in (("t", 0.0), ("y", np.nan), ("r", 0.0)))
        step = np.array([x["step"] for x in some])
        level, variance = smooth_many(t, y, r, step**2, (step / 4) ** 2)
        for j, x in enumerate(some):
            at = x["at"]
            parts.append(pd.DataFrame({"source": x["source"], "month": month, "slot": x["slots"], "value": level[j, at], "std": np.sqrt(variance[j, at]), "missing": x["n"] == 0, "n_readings": x["n"]}))
    columns = ["source", "month", "slot", "value", "std", "missing", "n_readings"]
    return pd.concat(parts, ignore_index=True)[columns] if parts else pd.DataFrame({c: [] for c in columns})


def regular(readings: DataFrame, source: str, time: str, value: str, weight: str, low: float = 0.0, high: float = 500.0) -> DataFrame:
    """One row per source and full hour (slot: whole hours since 1970) with value, std, missing flag and usable readings.

    The value holds at the full hour itself; `missing` says that no usable reading falls into the hour that begins there.
    """
    kind = readings.schema[source].dataType.simpleString()
    rows = readings.filter(F.col(source).isNotNull() & F.col(time).isNotNull() & usable(F.col(value), F.col(weight), low, high))
    rows = rows.select(F.col(source).alias("source"), F.col(time).alias("at"), F.col(value).cast("double").alias("v"), F.col(weight).cast("double").alias("w0"))
    rows = rows.withColumns({"month": F.trunc(F.col("at").cast("date"), "month"), "slot": hours(F.col("at")), "t": micros(F.col("at"))})
    bins = rows.groupBy("source", "month", "slot", F.floor(F.col("t") / (BIN_S * 1_000_000)).alias("bin")).agg(
        F.sum("w0").alias("w"), F.count("*").alias("n"), (F.sum(F.col("v") * F.col("w0")) / F.sum("w0")).alias("y"), (F.sum((F.col("t") - F.col("slot") * 3_600_000_000) * F.col("w0")) / F.sum("w0")).alias("offset")
    )
    bins = written(bins.select("source", "month", "slot", "n", "w", "y", (F.col("slot") * 3_600_000_000 + F.col("offset").cast("long")).alias("t")), "bins")
    # Scatter within an hour is the readings' noise, the step from hour to hour the level's.
    hourly = bins.groupBy("source", "month", "slot").agg(F.avg("y").alias("m"), F.stddev_samp("y").alias("sd"), F.sum("w").alias("w"), F.count("*").alias("k"))
    after = hourly.select("source", "month", (F.col("slot") - 1).alias("slot"), F.col("m").alias("m1"))
    noise = hourly.join(after, ["source", "month", "slot"], "left").groupBy("source").agg(
        F.percentile_approx(F.when(F.col("k") > 1, F.col("sd") * F.sqrt(F.col("w") / F.col("k"))), 0.5, 1000).alias("noise"), F.percentile_approx(F.abs(F.col("m1") - F.col("m")), 0.5, 1000).alias("step"),
        F.percentile_approx(F.abs(F.col("m")), 0.5, 1000).alias("level"),
    )
    noise = noise.select("source", F.coalesce("noise", "step", F.col("level") * 0.01).alias("noise"), F.coalesce("step", "noise", F.col("level") * 0.01).alias("step"))
    halo = HALO_H * 3600 * 1_000_000
    own = bins.withColumn("own", F.lit(True))
    # The end of a month serves the next month, its start the one before; a month without readings of its own is dropped.
    start = micros(F.col("month").cast("timestamp_ntz"))
    end = micros(F.add_months("month", 1).cast("timestamp_ntz"))
    late = bins.filter(F.col("t") >= end - halo).withColumn("month", F.add_months("month", 1))
    early = bins.filter(F.col("t") < start + halo).withColumn("month", F.add_months("month", -1))
    months = bins.select("source", "month").distinct()
    rest = late.unionByName(early).withColumn("own", F.lit(False)).join(months, ["source", "month"], "left_semi")
    # Sources of a month in buckets of about BUCKET_BINS bins: numpy smooths those of a bucket side by side.
    buckets = bins.groupBy("month").agg(F.ceil(F.count("*") / BUCKET_BINS).alias("buckets"))
    every = own.unionByName(rest).join(noise, "source").join(buckets, "month")
    grouped = every.withColumn("bucket", F.pmod(F.xxhash64("source"), F.col("buckets"))).drop("buckets").groupBy("month", "bucket")
    return grouped.applyInPandas(_smooth_bucket, OUT.format(kind=kind))


def missing_hours(readings: DataFrame, source: str, time: str, value: str, weight: str, **limits) -> DataFrame:
    """The slots of `regular` that no usable reading falls into (source, slot)."""
    return regular(readings, source, time, value, weight, **limits).filter("missing").select(F.col("source").alias(source), F.col("slot").alias("hour_slot"))
