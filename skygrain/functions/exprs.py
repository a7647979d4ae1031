"""Column expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0088
EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def finite(x: Column) -> Column:
    """True for a number that is neither null, NaN nor an infinity."""
    x = x.cast("double")
    return F.coalesce(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), F.lit(False))


def finite_or_null(x: Column) -> Column:
    return F.when(finite(x), x)


def micros(t: Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.expr(EPOCH), t)


def hours(t: Column) -> Column:
    """Whole hours since 1970, rounded down."""
    return F.floor(micros(t) / F.lit(3_600_000_000)).cast("long")


def lon180(lon: Column) -> Column:
    """Longitude in -180 up to but not 180."""
    return F.pmod(lon.cast("double") + 180.0, F.lit(360.0)) - 180.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))
