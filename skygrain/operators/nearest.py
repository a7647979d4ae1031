"""Distance of points to the nearest known one, however far that is."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skygrain.sources.scratch import written


def space_time(known: DataFrame, lat: str, lon: str, hours: str) -> tuple[dict[str, Column], float]:
    """Coordinates fitted on the known rows, and the side of a cube that holds about three of them.

    Degrees become kilometres at the mean latitude, and hours spread as far as places do. Longitudes are taken as they are.
    """
    k = 6371.0088 * math.pi / 180
    a = known.agg(F.count("*").alias("n"), F.avg(lat).alias("lat"), F.avg(hours).alias("t"), F.stddev_pop(hours).alias("sd"), F.stddev_pop(lon).alias("sx"), F.stddev_pop(lat).alias("sy"), *[(F.max(c) - F.min(c)).alias(f"span_{i}") for i, c in enumerate((lon, lat, hours))]).first()
    if not a["n"]:
        return {c: F.lit(0.0) for c in ("x", "y", "z")}, 1.0
    shrink, sd = math.cos(math.radians(a["lat"])), a["sd"] or 1.0
    scales = sorted(s for s in (k * shrink * a["sx"], k * a["sy"]) if s > 0)
    scale = sum(scales) / len(scales) if scales else 1.0
    spans = (k * shrink * a["span_0"], k * a["span_1"], a["span_2"] / sd * scale)
    side = 1.5 * (math.prod(max(s, scale / 100) for s in spans) / a["n"]) ** (1 / 3)
    return {"x": F.col(lon) * k * shrink, "y": F.col(lat) * k, "z": (F.col(hours) - a["t"]) / sd * scale}, side


def nearest_distance(points: DataFrame, known: DataFrame, key: str, axes: list[str], side: float) -> DataFrame:
    """(key, distance) of every point; the distance is null only if nothing is known.

    Points and known rows of equal coordinates are found first, then both meet in cubes. A point sees the two cubes nearest
    to it on every axis, so a distance of at most half a side is the least. Points without such a one go on to cubes of
    twice the side, until none is left. The side of fewer rows is the one that is copied into its eight cubes.
    """
    known = written(known.select(*axes).distinct(), "known")
    rows = written(points.select(key, *axes), "points")
    n = known.count()
    if not n:
        return rows.select(key, F.lit(None).cast("double").alias("distance"))
    met = written(rows.select(*axes).distinct().join(known.withColumn("distance", F.lit(0.0)), axes, "left"), "met")
    found, left = [met.filter("distance = 0")], met.filter("distance is null").select(*axes)
    cell = [f"_{c}" for c in axes]
    d2 = sum((F.pow(F.col(c) - F.col(f"k{c}"), 2) for c in axes), F.lit(0.0))
    while more := left.count():
        first = left.select(*axes, *[F.floor(F.col(c) / side - 0.5).cast("long").alias(f"_{c}") for c in axes])
        own = known.select(*[F.col(c).alias(f"k{c}") for c in axes], *[F.floor(F.col(c) / side).cast("long").alias(f"_{c}") for c in axes])
        for c in cell:
            if more < n:
                first = first.withColumn(c, F.explode(F.array(F.col(c), F.col(c) + 1)))
            else:
                own = own.withColumn(c, F.explode(F.array(F.col(c), F.col(c) - 1)))
        keys = axes if more < n else [*cell, *axes]
        met = written(first.join(own, cell, "left").groupBy(*keys).agg(F.sqrt(F.min(d2)).alias("distance")).select(*axes, "distance"), "met")
        found.append(met.filter(F.col("distance") <= side / 2))
        left = met.filter(F.col("distance").isNull() | (F.col("distance") > side / 2)).select(*axes)
        side *= 2
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return rows.join(out, axes).select(key, "distance")
