"""The queries of the general problems (1, 3, 4 and 7) over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from skygrain.operators import nearby, profile, regrid, spikes
from skygrain.sources.scratch import written
from skygrain.sources.tables import table

_P1 = ("platform", "TimeJD", "CLARA_radiance", "obs_id")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spikes.implausible(table(spark, sf_dir, "clara_full").select(*_P1), *_P1)


def p1_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spikes.score_readings(table(spark, sf_dir, "clara_full").select(*_P1), *_P1)


COVARIATES = ["era5_t2m", "era5_sp", "era5_tcwv", "era5_tp", "era5_lcc", "era5_mcc", "era5_hcc", "era5_u10", "era5_slt"]


def _columns(df: DataFrame) -> tuple[DataFrame, list[str], list[str]]:
    """df with times as text, and its numeric and its text columns but for the load's name."""
    kinds = {f.name: f.dataType for f in df.schema if f.name != "load_id"}
    numeric = [c for c, t in kinds.items() if isinstance(t, NumericType)]
    text = [c for c in kinds if c not in numeric]
    return df.withColumns({c: F.col(c).cast("string") for c in text}), numeric, text


def p3_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, numeric, text = _columns(table(spark, sf_dir, "clara_era5_merged"))
    return profile.profile(df, "load_id", numeric, text)


def p3_rare_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, numeric, text = _columns(table(spark, sf_dir, "clara_era5_merged"))
    return profile.mask_violations(df, "load_id", numeric, text)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "clara_era5_merged")
    profiles = written(profile.profile(e, "load_id", COVARIATES, ["source_file"]), "profile")
    shift = profile.shifts(profiles).select("load_id", "column_name", F.lit("shift").alias("kind"))
    report = profile.wrong_reports(profiles.filter(F.col("column_name") != "source_file"), table(spark, sf_dir, "covariate_summary"), "load_id", "variable")
    return shift.unionByName(report.select("load_id", "column_name", F.lit("report").alias("kind")))


QUERIES = {"p1_found": p1_found, "p1_scores": p1_scores, "p3_found": p3_found, "p3_profile": p3_profile, "p3_rare_masks": p3_rare_masks}


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearby.pairs_within(table(spark, sf_dir, "clara_era5_merged"), "row_id", "hour", "latitude", "longitude", 1.0, 42.0)


#: Areas of study: corners as (latitude, longitude), one with a bay, one across the date line, one that lies in another.
AREAS = {
    "middle": [(35.13, -10.37), (35.13, 40.41), (48.17, 40.41), (48.17, 15.29), (40.63, 12.71), (48.17, 5.33), (48.17, -10.37)],
    "inner": [(38.61, 0.13), (44.37, 20.77), (37.11, 25.91)],
    "south": [(-60.13, -70.39), (-5.57, -80.21), (-5.57, 30.87), (-60.13, 60.11)],
    "date line": [(-40.31, 150.67), (30.43, 140.19), (45.29, 200.53), (-20.71, 230.77)],
}


def p4_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The areas that contain each located row."""
    rings = ", ".join(f"('{name}', array({', '.join(f'struct({y}D as lat, {x}D as lon)' for y, x in ring)}))" for name, ring in AREAS.items())
    areas = spark.sql(f"select * from values {rings} as t(area, ring)")
    return nearby.containing(table(spark, sf_dir, "clara_era5_merged"), "row_id", "latitude", "longitude", areas, "area", "ring")


QUERIES |= {"p4_found": p4_found, "p4_regions": p4_regions}
_EDGES = ", ".join(f"('{name}', {a[0]}::double, {a[1]}::double, {b[0]}::double, {b[1]}::double)" for name, ring in AREAS.items() for a, b in zip(ring, ring[1:] + ring[:1]))


_P7 = ("cell_id", "hour", "clara_radiance_hourly_mean", "clara_n_datapoints")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regrid.missing_hours(table(spark, sf_dir, "clara_hourly_by_grid").select(*_P7), *_P7)


def p7_regular(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regrid.regular(table(spark, sf_dir, "clara_hourly_by_grid").select(*_P7), *_P7)


QUERIES |= {"p7_found": p7_found, "p7_regular": p7_regular}


SQL: dict[str, str] = {
    "p4_regions": f"""with e(area, y1, x1, y2, x2) as (values {_EDGES}),
 m as (select row_id, latitude::double y, ((longitude::double + 180) - 360 * floor((longitude::double + 180) / 360)) - 180 x from clara_era5_merged where latitude between -90 and 90 and isfinite(longitude)),
 t as (select row_id, y, x from m union all select row_id, y, x + 360 from m)
 select distinct row_id, area from (select row_id, x, area from t join e on (y1 > y) <> (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 group by 1, 2, 3 having count(*) % 2 = 1)""",
    "p4_found": """with m as (select row_id, hour, latitude::double lat, longitude::double lon from clara_era5_merged where latitude between -90 and 90 and isfinite(longitude))
 select a.row_id left_row_id, b.row_id right_row_id from m a join m b on a.hour = b.hour and a.row_id < b.row_id and abs(a.lat - b.lat) < 0.5
 where 2 * 6371.0088 * asin(sqrt(least(1, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) between 1 and 42""",
    "p7_found": """with g as (select cell_id, date_trunc('month', hour) mo, floor(epoch_us(hour) / 3600000000)::bigint s from clara_hourly_by_grid where cell_id is not null and hour is not null
 and isfinite(clara_radiance_hourly_mean) and clara_radiance_hourly_mean > 0 and clara_radiance_hourly_mean <= 500 and clara_n_datapoints > 0), b as (select cell_id, unnest(range(min(s), max(s) + 1)) hour_slot from g group by cell_id, mo)
 select cell_id, hour_slot from b anti join (select cell_id, s hour_slot from g) using (cell_id, hour_slot)""",
}
