"""Registration of queries with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skygrain.functions.exprs import finite
from skygrain.operators.quality import in_range
from skygrain.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str | None = None):
        def add(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = sql
            return f

        return add


#: Usable, located readings; the same as SQL.
OBS = """(select obs_id, platform, orbit_leg, TimeJD, CLARA_radiance v, CLARA_fov_latitude::double lat, CLARA_fov_longitude::double lon,
 CLARA_local_time::double lt, received_at from clara_full where TimeJD is not null and isfinite(CLARA_radiance) and CLARA_radiance > 0 and CLARA_radiance <= 500
 and isfinite(CLARA_fov_latitude) and isfinite(CLARA_fov_longitude))"""


def obs(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "clara_full")
    c = c.filter(F.col("TimeJD").isNotNull() & in_range(F.col("CLARA_radiance")) & finite(F.col("CLARA_fov_latitude")) & finite(F.col("CLARA_fov_longitude")))
    return c.select("obs_id", "platform", "orbit_leg", "TimeJD", F.col("CLARA_radiance").alias("v"), F.col("CLARA_fov_latitude").cast("double").alias("lat"), F.col("CLARA_fov_longitude").cast("double").alias("lon"), F.col("CLARA_local_time").cast("double").alias("lt"), "received_at")


#: Grid rows with possible coordinates, longitude in -180..180; cell indices are quarter degrees.
ERA = """(select *, round_even(latitude::double * 4, 0)::bigint iy, round_even(((longitude::double + 180) - 360 * floor((longitude::double + 180) / 360) - 180) * 4, 0)::bigint ix
 from clara_era5_merged where latitude between -90 and 90 and isfinite(longitude) and hour is not null)"""


def era(spark: SparkSession, d: str) -> DataFrame:
    from skygrain.functions.exprs import lon180

    e = table(spark, d, "clara_era5_merged")
    e = e.filter(F.col("latitude").between(-90, 90) & finite(F.col("longitude")) & F.col("hour").isNotNull())
    return e.withColumns({"iy": F.rint(F.col("latitude").cast("double") * 4).cast("long"), "ix": F.rint(lon180(F.col("longitude")) * 4).cast("long")})


COVARIATES = ["era5_t2m", "era5_sp", "era5_tcwv", "era5_tp", "era5_lcc", "era5_mcc", "era5_hcc", "era5_u10", "era5_slt"]


def long_sql(keys: str, source: str, columns: list[str] = COVARIATES) -> str:
    """The melted table as SQL: (keys, variable, value), non-finite values null."""
    return "(" + " union all ".join(f"select {keys}, '{c}' variable, case when isfinite({c}) then {c}::double end \"value\" from {source}" for c in columns) + ")"
