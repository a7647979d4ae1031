"""Scans, sinks, projections, filters, grids and joins over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skygrain.functions.exprs import finite, finite_or_null, haversine_km, hours, lon180, micros
from skygrain.operators import grid, nearest, quality, series, stats
from skygrain.plans.analysis import SAMPLED_PAIRS
from skygrain.plans.modelling import MATCHED, matched
from skygrain.plans.registry import COVARIATES, ERA, OBS, Registry, era, long_sql, obs
from skygrain.sources import files, scratch
from skygrain.sources.files import csv_by_position, file_inventory as inventory, julian_to_timestamp, read_geolocation, unit_triple
from skygrain.sources.scratch import written
from skygrain.sources.tables import table

query = Registry()
r6 = lambda c: F.round(c, 6)


# --- scans and sinks ---------------------------------------------------------------------------------------------------


_FIN = lambda c: f"case when isfinite({c}) then {c} end {c}"


def finite_floats(df: DataFrame) -> DataFrame:
    """df with NaN and infinities of its floating-point columns as null: done once, at the scan."""
    return df.withColumns({f.name: finite_or_null(F.col(f.name)) for f in df.schema if f.dataType.typeName() in ("float", "double")})


@query(f"select fix_id, fix_time, {_FIN('view_angle')}, {_FIN('latitude')}, {_FIN('longitude')} from clara_track where fix_time is not null")
def csv_roundtrip_scan(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "clara_track").filter("fix_time is not null")
    path = scratch.new_path(spark, "track-csv")
    cols = ["fix_id", "fix_time", "view_angle", "latitude", "longitude"]
    t.select(*[F.col(c).cast("string") for c in cols]).write.option("header", True).option("nullValue", "\\N").csv(path)
    raw = csv_by_position(spark, path, [0, 1, 2, 3, 4], cols, null="\\N")
    return finite_floats(raw.select(F.col("fix_id").cast("long"), F.col("fix_time").cast("timestamp_ntz"), *[F.col(c).try_cast("double") for c in cols[2:]]))


_JD = "(epoch_us(TimeJD) / 86400000000.0 + 2440587.5)"


@query(f"select obs_id, make_timestamp(round(({_JD} - 2440587.5) * 86400000000.0)::bigint) as ts from clara_full where TimeJD is not null")
def julian_day_to_ts(spark, d):
    """Times delivered as Julian Days in doubles, read back to the microseconds that a double holds."""
    path = scratch.new_path(spark, "julian-days")
    day = micros(F.col("TimeJD")) / F.lit(86_400_000_000.0) + F.lit(2440587.5)
    table(spark, d, "clara_full").filter("TimeJD is not null").select("obs_id", day.alias("julian_day")).write.parquet(path)
    return spark.read.schema("obs_id long, julian_day double").parquet(path).select("obs_id", julian_to_timestamp(F.col("julian_day")).alias("ts"))


def geolocation_delivery(spark: SparkSession, d: str) -> str:
    """Writes the track as one folder of CSV a day, named by day and version (odd days have a later one), positions as text triples."""
    t = finite_floats(table(spark, d, "clara_track").filter("fix_time is not null"))
    here = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    triple = F.when(here, unit_triple(F.col("latitude"), F.col("longitude"))).otherwise("(0.0,0.0,0.0)")
    version = F.when(F.day("fix_time") % 2 == 0, "V50_1_4").otherwise("V50_1_5")
    name = F.concat_ws("_", F.lit("geo"), F.date_format("fix_time", "yyyyMMdd"), version)
    path = scratch.new_path(spark, "geolocation")
    cols = {"time": F.col("fix_time").cast("string"), "angle": F.col("view_angle").cast("string"), "spare_2": F.lit("x"), "spare_3": F.lit("y"), "id": F.col("fix_id").cast("string"), "clara latitude": triple, "clara longitude": triple}
    t.select(name.alias("delivery"), *[c.alias(n) for n, c in cols.items()]).repartition("delivery").write.partitionBy("delivery").option("header", True).csv(path)
    return path


_POSITION = "case when isfinite(latitude) and isfinite(longitude) then"


@query(f"""select fix_id, fix_time, {_FIN('view_angle')}, round({_POSITION} latitude end, 5) + 0.0 latitude, round({_POSITION} ((longitude + 180) - 360 * floor((longitude + 180) / 360)) - 180 end, 5) + 0.0 longitude
 from clara_track where fix_time is not null""")
def vector_csv_scan(spark, d):
    """The track delivered as daily CSV folders with unit vectors as text, found by day whatever their version, and read by position."""
    fixes = read_geolocation(spark, geolocation_delivery(spark, d), "V50_1_4")
    r5 = lambda c: F.round(c, 5) + 0.0
    return finite_floats(fixes).select("fix_id", "fix_time", "view_angle", r5("latitude").alias("latitude"), r5("longitude").alias("longitude"))


@query(f"select obs_id, TimeJD, {_FIN('CLARA_radiance')}, {_FIN('CLARA_fov_latitude')}, {_FIN('CLARA_fov_longitude')} from clara_full")
def parquet_scan_project(spark, d):
    t = table(spark, d, "clara_full")
    need = ["obs_id", "TimeJD", "CLARA_radiance", "CLARA_fov_latitude", "CLARA_fov_longitude"]
    if gone := set(need) - set(t.columns):
        raise ValueError(f"missing columns: {sorted(gone)}")
    return finite_floats(t.select(*need))


@query(f"select row_id, hour, {_FIN('latitude')}, {_FIN('longitude')}, {_FIN('clara_radiance_hourly_mean')} from clara_era5_merged where clara_n_datapoints > 0")
def scan_filter_project(spark, d):
    return finite_floats(table(spark, d, "clara_era5_merged").filter("clara_n_datapoints > 0").select("row_id", "hour", "latitude", "longitude", "clara_radiance_hourly_mean"))


@query("""select source_file, count(*) n_rows, min(hour) first_hour, max(hour) last_hour, count(distinct latitude) n_latitudes, count(distinct longitude) n_longitudes
 from clara_era5_merged where source_file is not null group by 1""")
def file_inventory(spark, d):
    return inventory(table(spark, d, "clara_era5_merged"), "source_file", "hour", "latitude", "longitude")


@query("select hour, count(*) n_rows from clara_era5_merged where hour is not null group by 1")
def rows_per_hour(spark, d):
    return table(spark, d, "clara_era5_merged").filter("hour is not null").groupBy("hour").agg(F.count("*").alias("n_rows"))


@query("select min(obs_id) first_id, count(*) > 100000000 limited_scan from clara_full")
def limit_scan_flag(spark, d):
    """Whether a scan bound of 100 million rows would cut the table; the whole table is read."""
    return table(spark, d, "clara_full").agg(F.min("obs_id").alias("first_id"), (F.count("*") > 100_000_000).alias("limited_scan"))


@query(f"""select count(distinct iy) n_latitudes, count(distinct ix) n_longitudes, min(iy) / 4.0 lat_min, max(iy) / 4.0 lat_max, min(ix) / 4.0 lon_min, max(ix) / 4.0 lon_max from {ERA}""")
def grid_extent(spark, d):
    q = lambda f, c: (f(c) / 4.0)
    return era(spark, d).agg(F.count_distinct("iy").alias("n_latitudes"), F.count_distinct("ix").alias("n_longitudes"), q(F.min, "iy").alias("lat_min"), q(F.max, "iy").alias("lat_max"), q(F.min, "ix").alias("lon_min"), q(F.max, "ix").alias("lon_max"))


@query("""with d as (select TimeJD::date as day from clara_full where isfinite(CLARA_radiance) and CLARA_radiance > 0 and CLARA_radiance <= 500 and TimeJD is not null group by 1)
 select min(day) first_day, max(day) last_day, count(*) n_days, strftime(min(day), '%Y-%m') || '_' || strftime(max(day), '%Y-%m') span_label from d""")
def covered_span(spark, d):
    days = table(spark, d, "clara_full").filter(quality.in_range(F.col("CLARA_radiance")) & F.col("TimeJD").isNotNull()).select(F.col("TimeJD").cast("date").alias("day")).distinct()
    month = lambda f: F.date_format(f("day"), "yyyy-MM")
    return days.agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("*").alias("n_days"), F.concat(month(F.min), F.lit("_"), month(F.max)).alias("span_label"))


@query(f"""select platform, '{{"platform":"' || platform || '","n":' || sum(n)::bigint || ',"first_day":"' || min(day) || '","last_day":"' || max(day) || '","manifest":"' || substr(sha256(string_agg(day || ':' || n, ',' order by day)), 1, 16) || '"}}' as span
 from (select platform, TimeJD::date as day, count(*) n from {OBS} where platform is not null group by 1, 2) group by 1""")
def subset_span_json(spark, d):
    """Per platform one JSON document: rows, first and last day, and the digest of its days and their counts."""
    days = obs(spark, d).filter("platform is not null").groupBy("platform", F.col("TimeJD").cast("date").alias("day")).agg(F.count("*").alias("n"))
    listed = F.array_sort(F.collect_list(F.concat_ws(":", F.col("day").cast("string"), F.col("n").cast("string"))))  # as long as the record has days
    g = days.groupBy("platform").agg(F.sum("n").alias("n"), F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.substring(F.sha2(F.array_join(listed, ","), 256), 1, 16).alias("manifest"))
    return g.select("platform", F.to_json(F.struct("platform", "n", "first_day", "last_day", "manifest")).alias("span"))


@query("""select unnest(['build', 'first_hour', 'rows']) as key, unnest(['matched', min(hour)::varchar, count(*)::varchar]) as "value" from fold_assignments where hour is not null""")
def metadata_gate(spark, d):
    """A table written with entries in its footers, written anew with more of them, and read back behind a gate."""
    t = table(spark, d, "fold_assignments").filter("hour is not null")
    n = t.agg(F.count("*").cast("string").alias("rows"), F.min("hour").cast("string").alias("first_hour")).first().asDict()
    one, two = scratch.new_path(spark, "built"), scratch.new_path(spark, "merged")
    files.with_metadata(t, {"build": "matched"}).write.parquet(one)
    files.with_metadata(files.gated(spark.read.parquet(one), {"build": "matched"}), n).write.parquet(two)
    entries = files.metadata_of(files.gated(spark.read.parquet(two), {"build": "matched", "rows": None, "first_hour": None}))
    return spark.createDataFrame(sorted(entries.items()), "key string, value string")


@query("""with c as (select load_id, floor(row_id / 4096)::bigint chunk, sha256(string_agg(row_id::varchar, ',' order by row_id)) s from clara_era5_merged where load_id is not null group by 1, 2)
 select load_id, substr(sha256(string_agg(s, ',' order by chunk)), 1, 16) manifest_sha from c group by 1""")
def manifest_hash(spark, d):
    """A load's rows in one digest: that of the digests of its chunks of 4,096 ids, so no row holds a load's ids."""
    text = lambda a: F.array_join(F.transform(a, lambda i: i.cast("string")), ",")
    e = table(spark, d, "clara_era5_merged").filter("load_id is not null").select("load_id", "row_id", F.floor(F.col("row_id") / 4096).alias("chunk"))
    c = e.groupBy("load_id", "chunk").agg(F.sha2(text(F.array_sort(F.collect_list("row_id"))), 256).alias("s"))
    every = F.transform(F.array_sort(F.collect_list(F.struct("chunk", "s"))), lambda x: x["s"])
    return c.groupBy("load_id").agg(F.substring(F.sha2(F.array_join(every, ","), 256), 1, 16).alias("manifest_sha"))


@query("select strftime(hour, '%Y-%m') as month, count(*) n_rows, count(distinct hour) n_hours, round(sum(latitude::double), 6) checksum from clara_era5_merged where hour is not null and isfinite(latitude) group by 1")
def partitioned_roundtrip(spark, d):
    """Rows written by month, range-partitioned and sorted by hour, compressed with zstd, and read again."""
    path = scratch.new_path(spark, "by-month")
    t = table(spark, d, "clara_era5_merged").filter("hour is not null").withColumn("month", F.date_format("hour", "yyyy-MM"))
    t.repartitionByRange("hour").sortWithinPartitions("hour").write.option("compression", "zstd").partitionBy("month").parquet(path)
    back = spark.read.schema(t.schema).parquet(path).filter(finite(F.col("latitude")))
    return back.groupBy("month").agg(F.count("*").alias("n_rows"), F.count_distinct("hour").alias("n_hours"), r6(F.sum(F.col("latitude").cast("double"))).alias("checksum"))


@query("""select variable, count(*) n_loads, bool_and(n_rows is not null and n_missing is not null) complete from covariate_summary where variable is not null group by 1""")
def manifest_gate(spark, d):
    """Whether each variable's reports are complete; a caller raises on false."""
    ok = F.col("n_rows").isNotNull() & F.col("n_missing").isNotNull()
    return table(spark, d, "covariate_summary").filter("variable is not null").groupBy("variable").agg(F.count("*").alias("n_loads"), F.bool_and(ok).alias("complete"))


@query("""with want as (select distinct strftime(TimeJD, '%Y%m%d_%H') k from clara_full where TimeJD is not null), have as (select distinct substr(source_file, 6, 11) k from clara_era5_merged where source_file is not null)
 select 'era5_' || k || '.grib' filename from want anti join have using (k)""")
def pending_requests(spark, d):
    """Hours with readings for which no file has come."""
    want = table(spark, d, "clara_full").filter("TimeJD is not null").select(F.date_format("TimeJD", "yyyyMMdd_HH").alias("k")).distinct()
    have = table(spark, d, "clara_era5_merged").filter("source_file is not null").select(F.substring("source_file", 6, 11).alias("k")).distinct()
    return want.join(have, "k", "left_anti").select(F.concat(F.lit("era5_"), "k", F.lit(".grib")).alias("filename"))


# --- projections ---------------------------------------------------------------------------------------------------------


@query("""select row_id, round(era5_t2m::double - 273.15, 6) t2m_celsius, round(era5_lcc::double + era5_mcc::double + era5_hcc::double, 6) cloud_sum, round(abs(era5_u10::double), 6) wind_speed
 from clara_era5_merged""")
def derived_covariates(spark, d):
    """Derived covariates, each only where its inputs exist in the table."""
    t = table(spark, d, "clara_era5_merged")
    x = lambda c: F.col(c).cast("double")
    made = {
        "t2m_celsius": (["era5_t2m"], lambda: x("era5_t2m") - 273.15),
        "dewpoint_depression": (["era5_t2m", "era5_d2m"], lambda: x("era5_t2m") - x("era5_d2m")),
        "cloud_sum": (["era5_lcc", "era5_mcc", "era5_hcc"], lambda: x("era5_lcc") + x("era5_mcc") + x("era5_hcc")),
        "wind_speed": (["era5_u10"], lambda: F.sqrt(x("era5_u10") ** 2 + (x("era5_v10") ** 2 if "era5_v10" in t.columns else 0))),
    }
    return t.select("row_id", *[r6(f()).alias(name) for name, (need, f) in made.items() if set(need) <= set(t.columns)])


#: What each derived column is made of; inputs may be derived themselves.
DEPENDS = {"t2m_celsius": {"era5_t2m"}, "cloud_sum": {"era5_lcc", "era5_mcc", "era5_hcc"}, "clear_warmth": {"t2m_celsius", "cloud_sum"}}


def needed(wanted: set[str], depends: dict[str, set[str]] = DEPENDS) -> set[str]:
    """The stored columns that the wanted ones follow from, through any number of derivations; a circle is an error."""
    out, todo, seen = set(), list(wanted), set()
    while todo:
        c = todo.pop()
        if c in seen:
            continue
        seen.add(c)
        if c in depends:
            todo += depends[c]
        else:
            out.add(c)
    return out


@query("select row_id, hour, " + ", ".join(_FIN(c) for c in ("latitude", "longitude", "era5_t2m", "era5_lcc", "era5_mcc", "era5_hcc")) + " from clara_era5_merged")
def dependency_projection(spark, d):
    """The stored columns behind a derived one, in schema order: the closure of its dependencies reaches the scan."""
    t = table(spark, d, "clara_era5_merged")
    need = {"row_id", "hour", "latitude", "longitude"} | needed({"clear_warmth"})
    return finite_floats(t.select(*[c for c in t.columns if c in need]))


@query(f"""select row_id, (epoch_us(hour) - (select epoch_us(min(hour)) from {ERA})) / 3.6e9 hours_since_start, round(sin(2 * pi() * extract(hour from hour) / 24), 6) + 0.0 hour_sin, round(cos(2 * pi() * extract(hour from hour) / 24), 6) + 0.0 hour_cos,
 round(sin(2 * pi() * dayofyear(hour) / 366), 6) + 0.0 doy_sin, round(cos(2 * pi() * dayofyear(hour) / 366), 6) + 0.0 doy_cos, iy * iy / 16.0 lat2, ix * ix / 16.0 lon2, iy * ix / 16.0 lat_lon from {ERA}""")
def time_space_features(spark, d):
    e = era(spark, d)
    start = e.agg(F.min(micros(F.col("hour"))).alias("start"))
    turn = lambda f, x, n: r6(f(F.lit(2 * 3.141592653589793) * x / n)) + 0.0
    hour, day = F.hour("hour"), F.dayofyear("hour")
    out = e.join(F.broadcast(start))  # one row
    return out.select(
        "row_id", ((micros(F.col("hour")) - F.col("start")) / 3.6e9).alias("hours_since_start"), turn(F.sin, hour, 24).alias("hour_sin"), turn(F.cos, hour, 24).alias("hour_cos"),
        turn(F.sin, day, 366).alias("doy_sin"), turn(F.cos, day, 366).alias("doy_cos"), (F.col("iy") ** 2 / 16.0).alias("lat2"), (F.col("ix") ** 2 / 16.0).alias("lon2"), (F.col("iy") * F.col("ix") / 16.0).alias("lat_lon"),
    )


@query("""with c as (select distinct hour from clara_era5_merged where hour is not null),
 l as (select hour, hour + case when hour >= (date_trunc('month', hour) + interval 30 day)::timestamp and false then interval 1 hour when (month(hour) between 4 and 9)
   or (month(hour) = 3 and hour >= date_trunc('day', make_timestamp(year(hour), 3, 31, 1, 0, 0.0)) - interval 1 day * (isodow(make_timestamp(year(hour), 3, 31, 1, 0, 0.0)) % 7) + interval 1 hour)
   or (month(hour) = 10 and hour < date_trunc('day', make_timestamp(year(hour), 10, 31, 1, 0, 0.0)) - interval 1 day * (isodow(make_timestamp(year(hour), 10, 31, 1, 0, 0.0)) % 7) + interval 1 hour)
   then interval 2 hour else interval 1 hour end as t from c)
 select hour, round(extract(hour from t) + extract(minute from t) / 60.0, 6) local_hour from l""")
def local_time_cet(spark, d):
    """Clock time of Central Europe; a value outside [0, 24) is an error."""
    c = table(spark, d, "clara_era5_merged").filter("hour is not null").select("hour").distinct()
    # As a zoned time the UTC clock reads the session's zone, so the shift is taken between two zones.
    t = F.expr("convert_timezone('UTC', 'CET', hour)")
    local = F.hour(t) + F.minute(t) / 60.0 + F.second(t) / 3600.0
    return c.select("hour", r6(F.when(local.between(0, 23.9999999), local).otherwise(F.raise_error(F.lit("local time out of range")))).alias("local_hour"))


@query(f"""with a as (select obs_id, (lon + 180) - 360 * floor((lon + 180) / 360) - 180 as lon, (epoch_us(TimeJD) % 86400000000) / 3.6e9 as h from {OBS})
 select obs_id, round(lon, 6) lon180, round(lon - 360 * floor(lon / 360), 6) lon360, round((h + lon / 15) - 24 * floor((h + lon / 15) / 24), 6) solar_time from a""")
def solar_local_time(spark, d):
    a = obs(spark, d).select("obs_id", lon180(F.col("lon")).alias("lon"), (F.pmod(micros(F.col("TimeJD")), F.lit(86_400_000_000)) / 3.6e9).alias("h"))
    return a.select("obs_id", r6("lon").alias("lon180"), r6(F.pmod("lon", F.lit(360.0))).alias("lon360"), r6(F.pmod(F.col("h") + F.col("lon") / 15, F.lit(24.0))).alias("solar_time"))


@query("select obs_id, round(ln(CLARA_radiance), 6) log_radiance from clara_full where isfinite(CLARA_radiance) and CLARA_radiance > 0")
def log_target(spark, d):
    """Logarithms of the positive finite values; none at all is an error."""
    positive = table(spark, d, "clara_full").filter(finite(F.col("CLARA_radiance")) & (F.col("CLARA_radiance") > 0))
    return quality.some(positive, "positive radiance").select("obs_id", r6(F.ln("CLARA_radiance")).alias("log_radiance"))


@query("""select variable, case when variable = 'era5_slt' then 'categorical' else 'continuous' end kind, case when variable like 'era5\\_%' escape '\\' then 'Atmospheric' else 'Other' end feature_group, count(*) n_reports from covariate_summary where variable is not null group by 1""")
def feature_group_case(spark, d):
    g = table(spark, d, "covariate_summary").filter("variable is not null").groupBy("variable").agg(F.count("*").alias("n_reports"))
    return g.select("variable", F.when(F.col("variable").isin("era5_slt"), "categorical").otherwise("continuous").alias("kind"), F.when(F.col("variable").startswith("era5_"), "Atmospheric").otherwise("Other").alias("feature_group"), "n_reports")


@query(f"""select hour, {_FIN('latitude')}, {_FIN('longitude')}, {_FIN('clara_radiance_hourly_mean')}, clara_n_datapoints, {_FIN('era5_t2m')} from
 (select hour, latitude, longitude, clara_radiance_hourly_mean::float clara_radiance_hourly_mean, coalesce(clara_n_datapoints, 0)::int clara_n_datapoints, null::float era5_t2m from clara_hourly_by_grid
 union all select hour, latitude, longitude, clara_radiance_hourly_mean::float, coalesce(clara_n_datapoints, 0)::int, era5_t2m from clara_era5_merged)""")
def conform_schema_union(spark, d):
    """Two tables in one schema: missing columns null, counts 0, extra columns dropped, types cast."""
    kinds = {"hour": "timestamp_ntz", "latitude": "float", "longitude": "float", "clara_radiance_hourly_mean": "float", "clara_n_datapoints": "int", "era5_t2m": "float"}
    both = table(spark, d, "clara_hourly_by_grid").unionByName(table(spark, d, "clara_era5_merged"), allowMissingColumns=True)
    return finite_floats(both.select(*[(F.coalesce(F.col(c), F.lit(0)) if c.endswith("_n_datapoints") else F.col(c)).cast(t).alias(c) for c, t in kinds.items()]))


@query("select cell_id, hour, clara_radiance_hourly_mean::float mean32, coalesce(clara_n_datapoints, 0)::int n32 from clara_hourly_by_grid")
def cast_narrow(spark, d):
    return table(spark, d, "clara_hourly_by_grid").select("cell_id", "hour", F.col("clara_radiance_hourly_mean").cast("float").alias("mean32"), F.coalesce("clara_n_datapoints", F.lit(0)).cast("int").alias("n32"))


@query("select variable, coalesce(max(label), replace(variable, '_', ' ')) as label from covariate_summary where variable is not null group by 1")
def label_lookup(spark, d):
    g = table(spark, d, "covariate_summary").filter("variable is not null").groupBy("variable").agg(F.max("label").alias("label"))
    return g.select("variable", F.coalesce("label", F.translate("variable", "_", " ")).alias("label"))


@query("select obs_id, case when isinf(CLARA_radiance) or isnan(CLARA_radiance) then null else CLARA_radiance end v from clara_full")
def inf_to_null(spark, d):
    return table(spark, d, "clara_full").select("obs_id", finite_or_null(F.col("CLARA_radiance")).alias("v"))


@query("select o_orderkey, try_cast(o_orderpriority as double) as whole, try_cast(substr(o_orderpriority, 1, 1) as double) as head from orders")
def coerce_numeric(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").try_cast("double").alias("whole"), F.substring("o_orderpriority", 1, 1).try_cast("double").alias("head"))


# --- filters -------------------------------------------------------------------------------------------------------------


@query("select obs_id, CLARA_radiance from clara_full where isfinite(CLARA_radiance) and CLARA_radiance > 0 and CLARA_radiance <= 500")
def radiance_filter(spark, d):
    return table(spark, d, "clara_full").filter(quality.in_range(F.col("CLARA_radiance"))).select("obs_id", "CLARA_radiance")


@query("""with c as (select CLARA_radiance x from clara_full) select 'nonfinite' reason, count(*) filter (not coalesce(isfinite(x), false)) n_rows from c
 union all select 'at_or_below_min', count(*) filter (isfinite(x) and x <= 0) from c union all select 'above_max', count(*) filter (isfinite(x) and x > 500) from c""")
def rejection_report(spark, d):
    return quality.rejections(table(spark, d, "clara_full"), F.col("CLARA_radiance"))


@query("""with c as (select *, coalesce(TimeJD >= timestamp '2025-10-15', false) a, coalesce(isfinite(CLARA_radiance), false) b, coalesce(CLARA_radiance > 0 and CLARA_radiance <= 500, false) r from clara_full),
 n as (select count(*) l, count(*) filter (a) w, count(*) filter (a and b) f, count(*) filter (a and b and r) q from c)
 select unnest(['loaded', 'window', 'finite', 'range']) step, unnest([l, w, f, q]) n_rows, unnest([l / l, w / l, f / l, q / l]) fraction_of_loaded from n""")
def retention_steps(spark, d):
    v = F.col("CLARA_radiance")
    return quality.retention(table(spark, d, "clara_full"), {"window": F.col("TimeJD") >= F.expr("TIMESTAMP_NTZ'2025-10-15'"), "finite": finite(v), "range": quality.in_range(v)})


@query(f"select obs_id, lat, lon from {OBS} where year(TimeJD) = 2025 and lat between 35 and 48 and lon between -10 and 40")
def bbox_filter(spark, d):
    return obs(spark, d).filter((F.year("TimeJD") == 2025) & F.col("lat").between(35, 48) & F.col("lon").between(-10, 40)).select("obs_id", "lat", "lon")


@query("select row_id, hour from clara_era5_merged where hour >= timestamp '2025-12-01' and hour <= timestamp '2025-12-05'")
def date_range_filter(spark, d):
    """Both ends inclusive: of the last day only midnight."""
    return table(spark, d, "clara_era5_merged").filter("hour >= TIMESTAMP_NTZ'2025-12-01' and hour <= TIMESTAMP_NTZ'2025-12-05'").select("row_id", "hour")


@query("select obs_id, TimeJD from clara_full where TimeJD >= timestamp '2025-10-10' and TimeJD < timestamp '2025-11-10'")
def half_open_clip(spark, d):
    return table(spark, d, "clara_full").filter("TimeJD >= TIMESTAMP_NTZ'2025-10-10' and TimeJD < TIMESTAMP_NTZ'2025-11-10'").select("obs_id", "TimeJD")


@query(f"select obs_id, lt, round(least(lt, 24 - lt), 6) from_midnight from {OBS} where isfinite(lt) and least(lt, 24 - lt) <= 0.5".replace("lt, round", "round(lt, 6) lt, round"))
def midnight_window(spark, d):
    near = F.least(F.col("lt"), 24 - F.col("lt"))
    return obs(spark, d).filter(finite(F.col("lt")) & (near <= 0.5)).select("obs_id", r6("lt").alias("lt"), r6(near).alias("from_midnight"))


@query(f"""with e as (select min(iy) / 4.0 a, max(iy) / 4.0 b, min(ix) / 4.0 x, max(ix) / 4.0 y from {ERA} where load_id = (select min(load_id) from {ERA})) select obs_id from {OBS}, e where lat between a and b and (y - x >= 360 - 0.25 or lon between x and y)""")
def grid_range_filter(spark, d):
    """Readings within the first load's grid; a grid around the globe bounds the latitude only."""
    e = era(spark, d)
    first = e.agg(F.min("load_id").alias("load_id"))
    extent = e.join(F.broadcast(first), "load_id").agg((F.min("iy") / 4.0).alias("a"), (F.max("iy") / 4.0).alias("b"), (F.min("ix") / 4.0).alias("x"), (F.max("ix") / 4.0).alias("y"))
    return obs(spark, d).join(F.broadcast(extent), F.col("lat").between(F.col("a"), F.col("b")) & ((F.col("y") - F.col("x") >= 360 - 0.25) | F.col("lon").between(F.col("x"), F.col("y")))).select("obs_id")  # one row


@query("select row_id from clara_era5_merged where not isnan(era5_t2m) and not isnan(era5_sp) and not isnan(era5_slt) and era5_t2m is not null and era5_sp is not null and era5_slt is not null")
def dropna_subset(spark, d):
    return table(spark, d, "clara_era5_merged").dropna(subset=["era5_t2m", "era5_sp", "era5_slt"]).select("row_id")


@query(f"""select variable, count(value) n_used, count(distinct value) n_distinct from {long_sql('hour', "(select * from clara_era5_merged where isfinite(clara_radiance_hourly_mean))")} group by 1 having count(value) >= 20 and count(distinct value) >= 2""")
def usable_covariates(spark, d):
    e = table(spark, d, "clara_era5_merged").filter(finite(F.col("clara_radiance_hourly_mean")))
    g = stats.melted(e, ["hour"], COVARIATES).groupBy("variable").agg(F.count("value").alias("n_used"), F.count_distinct("value").alias("n_distinct"))
    return g.filter("n_used >= 20 and n_distinct >= 2")


@query("select row_id from clara_era5_merged where clara_n_datapoints > 0 and isfinite(era5_t2m) and hour = (select max(hour) from clara_era5_merged where isfinite(era5_t2m) and clara_n_datapoints > 0)")
def composed_predicate(spark, d):
    e = table(spark, d, "clara_era5_merged").filter((F.col("clara_n_datapoints") > 0) & finite(F.col("era5_t2m")))
    return e.join(F.broadcast(e.agg(F.max("hour").alias("hour"))), "hour").select("row_id")  # one row


@query("select max(hour) as latest_hour from clara_era5_merged where isfinite(era5_t2m)")
def latest_hour(spark, d):
    return table(spark, d, "clara_era5_merged").filter(finite(F.col("era5_t2m"))).agg(F.max("hour").alias("latest_hour"))


@query("select hour, count(*) n_rows, hour = max(hour) over () latest from clara_era5_merged where isfinite(era5_t2m) and hour is not null group by 1")
def prediction_hours(spark, d):
    """All hours with a valid reference covariate, the latest marked."""
    h = table(spark, d, "clara_era5_merged").filter(finite(F.col("era5_t2m")) & F.col("hour").isNotNull()).groupBy("hour").agg(F.count("*").alias("n_rows"))
    h = written(h, "hours")
    return h.join(F.broadcast(h.agg(F.max("hour").alias("top")))).select("hour", "n_rows", (F.col("hour") == F.col("top")).alias("latest"))  # one row


@query("select obs_id from clara_full where date_trunc('minute', TimeJD) in (select hour from clara_era5_merged)")
def exact_minute_semi(spark, d):
    minute = F.floor(micros(F.col("TimeJD")) / 60_000_000)
    grid_minutes = table(spark, d, "clara_era5_merged").filter("hour is not null").select((micros(F.col("hour")) / 60_000_000).cast("long").alias("m")).distinct()
    return table(spark, d, "clara_full").select("obs_id", minute.cast("long").alias("m")).join(grid_minutes, "m", "left_semi").select("obs_id")


@query("""select load_id, count(*) n_rows from clara_era5_merged where load_id is not null group by 1 having count(*) < 100000 and bool_and(era5_tp = 0)""")
def dead_file_detect(spark, d):
    e = table(spark, d, "clara_era5_merged").filter("load_id is not null")
    return quality.dead_groups(e, "load_id", "era5_tp", 100_000)


@query("""with m as (select distinct platform, date_trunc('month', TimeJD)::date mo from clara_full where platform is not null and TimeJD is not null),
 e as (select platform, unnest(generate_series(min(mo), max(mo), interval 1 month))::date mo from m group by 1) select platform, mo as month from e anti join m using (platform, mo)""")
def absent_months(spark, d):
    m = table(spark, d, "clara_full").filter("platform is not null and TimeJD is not null").select("platform", F.trunc(F.col("TimeJD").cast("date"), "month").alias("month")).distinct()
    every = m.groupBy("platform").agg(F.explode(F.sequence(F.min("month"), F.max("month"), F.expr("interval 1 month"))).alias("month"))
    return every.join(m, ["platform", "month"], "left_anti")


@query(f"""with e as (select min(hour) t0, max(hour) t1, min(iy) / 4.0 a, max(iy) / 4.0 b from {ERA}), g as (select distinct hour from {ERA}),
 o as (select TimeJD between t0 and t1 as intime, lat between a and b as inlat, date_trunc('minute', TimeJD) in (select hour from g) as exact from {OBS}, e)
 select count(*) n, count(*) filter (intime) n_in_time, count(*) filter (inlat) n_in_extent, count(*) filter (intime and inlat) n_overlap, count(*) filter (exact) n_exact_minute, count(*) filter (exact and inlat) n_exact_in_extent,
 round(count(*) filter (intime and inlat) / count(*), 6) overlap_share from o""")
def overlap_counts(spark, d):
    """Readings within the grid's time range, its extent, at a grid time to the minute, and their conjunctions."""
    grid_rows = era(spark, d)
    e = grid_rows.agg(F.min("hour").alias("t0"), F.max("hour").alias("t1"), (F.min("iy") / 4.0).alias("a"), (F.max("iy") / 4.0).alias("b"))
    minutes = grid_rows.select((micros(F.col("hour")) / 60_000_000).cast("long").alias("m")).distinct().withColumn("hit", F.lit(True))
    o = obs(spark, d).withColumn("m", F.floor(micros(F.col("TimeJD")) / 60_000_000).cast("long")).join(minutes, "m", "left").join(F.broadcast(e))  # one row
    t, i, x = F.col("TimeJD").between(F.col("t0"), F.col("t1")), F.col("lat").between(F.col("a"), F.col("b")), F.coalesce("hit", F.lit(False))
    counts = {"n_in_time": t, "n_in_extent": i, "n_overlap": t & i, "n_exact_minute": x, "n_exact_in_extent": x & i}
    return o.agg(F.count("*").alias("n"), *[F.count_if(c).alias(n) for n, c in counts.items()], r6(F.count_if(t & i) / F.count("*")).alias("overlap_share"))


# --- grids and joins --------------------------------------------------------------------------------------------------

STEP = 2.0  # degrees of the analysis grid
_CELL = f"round_even(lat / {STEP}, 0)::bigint iy, (round_even((lon - 360 * floor(lon / 360)) / {STEP}, 0)::bigint % {int(360 / STEP)}) ix, date_trunc('hour', TimeJD) as hour"
CELL_MEANS = f"(select hour, iy, ix, round(avg(v), 6) mean, count(*) n from (select v, {_CELL} from {OBS}) group by 1, 2, 3)"


def _cell_means(spark, d):
    o = obs(spark, d).select("v", F.date_trunc("hour", "TimeJD").cast("timestamp_ntz").alias("hour"), grid.cell_index(F.col("lat"), 0.0, STEP).alias("iy"), grid.wrapped_index(F.col("lon"), 0.0, STEP).alias("ix"))
    return grid.hourly_mean(o, ["hour", "iy", "ix"], "v").withColumn("mean", r6("mean"))


@query(f"select * from {CELL_MEANS}")
def hourly_grid_mean(spark, d):
    return _cell_means(spark, d)


GRID_ROWS = f"(select distinct hour, round_even(iy / 4.0 / {STEP}, 0)::bigint iy, (round_even((ix / 4.0 - 360 * floor(ix / 4.0 / 360)) / {STEP}, 0)::bigint % {int(360 / STEP)}) ix from {ERA})"


def _grid_rows(spark, d):
    return era(spark, d).select("hour", grid.cell_index(F.col("iy") / 4.0, 0.0, STEP).alias("iy"), grid.wrapped_index(F.col("ix") / 4.0, 0.0, STEP).alias("ix")).distinct()


@query(f"select g.hour, g.iy, g.ix, mean, coalesce(n, 0) n from {GRID_ROWS} g left join {CELL_MEANS} m using (hour, iy, ix)")
def grid_left_join(spark, d):
    return grid.grid_left(_grid_rows(spark, d), _cell_means(spark, d), ["hour", "iy", "ix"], "n")


@query(f"""with lt as (select hour, iy, ix, round(avg(local_time::double), 6) local_time from (select local_time, hour, round_even(iy / 4.0 / {STEP}, 0)::bigint iy, (round_even((ix / 4.0 - 360 * floor(ix / 4.0 / 360)) / {STEP}, 0)::bigint % {int(360 / STEP)}) ix from {ERA} where isfinite(local_time)) group by 1, 2, 3)
 select m.hour, m.iy, m.ix, mean, n, local_time from {CELL_MEANS} m join {GRID_ROWS} g using (hour, iy, ix) left join lt using (hour, iy, ix)""")
def matched_inner_join(spark, d):
    e = era(spark, d).filter(finite(F.col("local_time"))).select(F.col("local_time").cast("double"), "hour", grid.cell_index(F.col("iy") / 4.0, 0.0, STEP).alias("iy"), grid.wrapped_index(F.col("ix") / 4.0, 0.0, STEP).alias("ix"))
    local = e.groupBy("hour", "iy", "ix").agg(r6(F.avg("local_time")).alias("local_time"))
    keys = ["hour", "iy", "ix"]
    return _cell_means(spark, d).join(_grid_rows(spark, d), keys).join(local, keys, "left")


@query("""with h as (select distinct hour from clara_era5_merged where hour is not null), a as (select unnest(range(-6, 7)) i), b as (select unnest(range(-6, 6)) j) select hour, i * 15.0 latitude, j * 30.0 longitude from h, a, b""")
def grid_crossjoin(spark, d):
    """Every hour of the table on a 15 by 30 degree grid; the axes are a literal of 156 points."""
    h = table(spark, d, "clara_era5_merged").filter("hour is not null").select("hour").distinct()
    return h.select("hour", F.explode(grid.axes((-90.0, 90.0, 15.0), (-180.0, 150.0, 30.0))).alias("p")).select("hour", "p.*")


_AXIS = [-90, -60, -30, -10, 0, 10, 30, 60, 90]


@query(f"select obs_id, list_min(list_transform([{', '.join(map(str, _AXIS))}], lambda g: {{'d': abs(g - lat), 'g': g::double}})).g as nearest from {OBS}")
def nearest_grid_value(spark, d):
    return obs(spark, d).select("obs_id", grid.nearest_value(F.col("lat"), _AXIS).alias("nearest"))


@query(f"select obs_id, round_even((lon - 360 * floor(lon / 360)) / 0.25, 0)::bigint % 1440 as cell from {OBS}")
def nearest_longitude_wrap(spark, d):
    return obs(spark, d).select("obs_id", grid.wrapped_index(F.col("lon"), 0.0, 0.25).alias("cell"))


_TRACK = """(select p, t, v.lat latitude, v.lon longitude, v.angle view_angle from (select lower(trim(platform)) p, fix_time t, arg_min({'lat': latitude, 'lon': longitude, 'angle': case when isfinite(view_angle) then view_angle end}, fix_id) v
 from clara_track where platform is not null and fix_time is not null and isfinite(latitude) and isfinite(longitude) group by 1, 2))"""
_SAMPLES = "(select obs_id, lower(trim(platform)) p, TimeJD t from clara_full where platform is not null and TimeJD is not null)"


def _clocks(spark, d):
    """(readings, fixes) with platform p and time; fixes with a position only, names in one form."""
    same = F.lower(F.trim("platform")).alias("p")
    known = F.col("platform").isNotNull() & F.col("fix_time").isNotNull() & finite(F.col("latitude")) & finite(F.col("longitude"))
    track = table(spark, d, "clara_track").filter(known).select("fix_id", same, F.col("fix_time").alias("time"), "latitude", "longitude", finite_or_null(F.col("view_angle")).alias("view_angle"))
    samples = table(spark, d, "clara_full").filter("platform is not null and TimeJD is not null").select("obs_id", same, F.col("TimeJD").alias("time"))
    return samples, track


_UNIT = "cos(radians({0}latitude)) * cos(radians({0}longitude)) {0}x, cos(radians({0}latitude)) * sin(radians({0}longitude)) {0}y, sin(radians({0}latitude)) {0}z"
_BOTH = f"""b as (select s.obs_id, s.p, s.t, k.t t0, k.latitude, k.longitude, k.view_angle a0 from {_SAMPLES} s asof left join {_TRACK} k on s.p = k.p and s.t >= k.t),
 a as (select s.obs_id, k.t t1, k.latitude, k.longitude, k.view_angle a1 from {_SAMPLES} s asof left join {_TRACK} k on s.p = k.p and s.t <= k.t)"""


@query(f"""with {_BOTH}, d as (select p, median(epoch_us(t) - epoch_us(l)) m from (select p, t, lag(t) over (partition by p order by t) l from {_TRACK}) where l is not null group by 1),
 u as (select obs_id, b.p, epoch_us(t) t, epoch_us(t0) t0, epoch_us(t1) t1, a0, a1, cos(radians(b.latitude)) * cos(radians(b.longitude)) x0, cos(radians(b.latitude)) * sin(radians(b.longitude)) y0, sin(radians(b.latitude)) z0,
   cos(radians(a.latitude)) * cos(radians(a.longitude)) x1, cos(radians(a.latitude)) * sin(radians(a.longitude)) y1, sin(radians(a.latitude)) z1 from b join a using (obs_id)),
 g as (select u.*, least(t - t0, t1 - t) gap, case when t1 > t0 then (t - t0) / (t1 - t0) when t1 = t0 then 0.0 end share, greatest(60000000, 3 * d.m) reach from u left join d using (p)),
 w as (select obs_id, case when t0 is not null and t1 is not null then gap end gap, case when gap <= reach and t0 is not null and t1 is not null then share end s, * exclude (obs_id, gap) from g),
 i as (select obs_id, gap, x0 + (x1 - x0) * s x, y0 + (y1 - y0) * s y, z0 + (z1 - z0) * s z, a0 + (a1 - a0) * s angle from w)
 select obs_id, round(degrees(asin(greatest(-1, least(1, z / sqrt(x * x + y * y + z * z))))), 5) + 0.0 latitude, round(degrees(atan2(y, x)), 5) + 0.0 longitude, round(angle, 5) + 0.0 view_angle, gap / 1e6 gap_seconds from i""")
def interp_track(spark, d):
    """Position, view angle and measured gap of every reading from the track.

    The unit vector is interpolated between the fixes before and after, so tracks cross the date line and the poles. Null
    outside the track, or if the nearer fix is beyond three times the platform's median cadence, and 60 seconds.
    """
    samples, track = _clocks(spark, d)
    lat, lon = F.radians("latitude"), F.radians("longitude")
    track = track.withColumns({"x": F.cos(lat) * F.cos(lon), "y": F.cos(lat) * F.sin(lon), "z": F.sin(lat), "us": micros(F.col("time"))})
    own = Window.partitionBy("p", F.floor(F.col("us") / 3_600_000_000)).orderBy("us")
    # Steps within an hour; the few from one hour into another don't move a median that is held against 60 seconds.
    steps = track.select("p", "us").distinct().withColumn("step", F.col("us") - F.lag("us").over(own))
    cadence = steps.groupBy("p").agg((3 * F.percentile_approx("step", 0.5, 100_000)).alias("reach")).withColumn("reach", F.greatest(F.lit(60_000_000), F.col("reach")))
    values = ["x", "y", "z", "view_angle"]
    b = series.bracketed(samples, track, "p", "time", "fix_id", values).join(cadence, "p", "left")
    i = series.interpolated(b.withColumn("gap", series.gap(b)), values)
    i = i.withColumns({v: F.when(F.col("gap") <= F.col("reach"), F.col(v)) for v in values})
    norm = F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)
    r5 = lambda c: F.round(c, 5) + 0.0
    latitude = F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("z") / norm))))
    return i.select("obs_id", r5(latitude).alias("latitude"), r5(F.degrees(F.atan2("y", "x"))).alias("longitude"), r5("view_angle").alias("view_angle"), (F.col("gap") / 1e6).alias("gap_seconds"))


@query(f"""with {_BOTH}, g as (select obs_id, least(coalesce(epoch_us(t) - epoch_us(t0), 9000000000000), coalesce(epoch_us(t1) - epoch_us(t), 9000000000000)) gap_us from a join b using (obs_id)) select * from g where gap_us <= 4000000""")
def asof_nearest_tolerance(spark, d):
    samples, track = _clocks(spark, d)
    b = series.bracketed(samples, track, "p", "time", "fix_id", ["latitude"])
    gap = F.least(F.col("t") - F.col("t_before"), F.col("t_after") - F.col("t"))
    return b.select("obs_id", gap.alias("gap_us")).filter("gap_us <= 4000000")


@query("""with t as (select lower(trim(platform)) p, fix_time::date fd, count(*) c from clara_track where platform is not null and fix_time is not null group by 1, 2), s as (select lower(trim(platform)) p, TimeJD::date sd, count(*) n from clara_full where platform is not null and TimeJD is not null group by 1, 2)
 select p, sd as "day", n n_samples, sum(c)::bigint n_track from s join t using (p) where fd between sd - interval 1 day and sd + interval 1 day group by 1, 2, 3""")
def padded_day_join(spark, d):
    """Each day of samples sees the track of the day before to the day after."""
    same = F.lower(F.trim("platform")).alias("p")
    t = table(spark, d, "clara_track").filter("platform is not null and fix_time is not null").groupBy(same, F.col("fix_time").cast("date").alias("f")).agg(F.count("*").alias("c"))
    t = t.select("p", "c", F.explode(F.array(*[F.date_add("f", k) for k in (-1, 0, 1)])).alias("day"))
    s = table(spark, d, "clara_full").filter("platform is not null and TimeJD is not null").groupBy(same, F.col("TimeJD").cast("date").alias("day")).agg(F.count("*").alias("n_samples"))
    return s.join(t, ["p", "day"]).groupBy("p", "day", "n_samples").agg(F.sum("c").alias("n_track"))


@query("""with e as (select hour, count(*) n_grid, count(*) filter (clara_n_datapoints > 0) n_matched from clara_era5_merged where hour is not null group by 1), o as (select date_trunc('hour', TimeJD) as hour, count(*) n_obs from clara_full where TimeJD is not null group by 1)
 select hour, n_grid, n_matched, coalesce(n_obs, 0) n_obs, round(n_matched / n_grid, 6) match_rate from e left join o using (hour)""")
def hourly_match_summary(spark, d):
    e = table(spark, d, "clara_era5_merged").filter("hour is not null").groupBy("hour").agg(F.count("*").alias("n_grid"), F.count_if(F.col("clara_n_datapoints") > 0).alias("n_matched"))
    o = table(spark, d, "clara_full").filter("TimeJD is not null").groupBy(F.date_trunc("hour", "TimeJD").cast("timestamp_ntz").alias("hour")).agg(F.count("*").alias("n_obs"))
    return e.join(o, "hour", "left").select("hour", "n_grid", "n_matched", F.coalesce("n_obs", F.lit(0)).alias("n_obs"), r6(F.col("n_matched") / F.col("n_grid")).alias("match_rate"))


@query(f"""with a as (select date_trunc('hour', TimeJD) as hour, count(*) n_raw, round(avg(v), 6) raw_mean from {OBS} group by 1), b as (select date_trunc('hour', hour) as hour, count(*) n_cells, round(avg(clara_radiance_hourly_mean), 6) grid_mean from clara_hourly_by_grid where isfinite(clara_radiance_hourly_mean) and hour is not null group by 1)
 select hour, n_raw, raw_mean, n_cells, grid_mean from a full join b using (hour)""")
def hourly_full_outer(spark, d):
    a = obs(spark, d).groupBy(F.date_trunc("hour", "TimeJD").cast("timestamp_ntz").alias("hour")).agg(F.count("*").alias("n_raw"), r6(F.avg("v")).alias("raw_mean"))
    g = table(spark, d, "clara_hourly_by_grid").filter(finite(F.col("clara_radiance_hourly_mean")) & F.col("hour").isNotNull())
    return a.join(g.groupBy(F.date_trunc("hour", "hour").cast("timestamp_ntz").alias("hour")).agg(F.count("*").alias("n_cells"), r6(F.avg("clara_radiance_hourly_mean")).alias("grid_mean")), "hour", "outer")


@query("""with h as (select distinct cell_id, floor(epoch_us(hour) / 3600000000)::bigint s from clara_hourly_by_grid where hour is not null), e as (select cell_id, unnest(range(min(s), max(s) + 1)) s from h group by 1) select cell_id, s as hour_slot from e anti join h using (cell_id, s)""")
def missing_keys_anti(spark, d):
    """Hours of each cell, from its first to its last, without any row."""
    h = table(spark, d, "clara_hourly_by_grid").filter("hour is not null").select("cell_id", hours(F.col("hour")).alias("hour_slot")).distinct()
    every = h.groupBy("cell_id").agg(F.explode(F.sequence(F.min("hour_slot"), F.max("hour_slot"))).alias("hour_slot"))
    return every.join(h, ["cell_id", "hour_slot"], "left_anti")


@query(f"""with o as (select *, year(TimeJD) y, month(TimeJD) m, hour(TimeJD) h, ((lon + 180) - 360 * floor((lon + 180) / 360) - 180) l from {OBS}), s as (select y, m, h, max(l) - min(l) > 180 split from o group by 1, 2, 3),
 p as (select o.*, case when split then case when l < 0 then 'w' else 'e' end else '' end part from o join s using (y, m, h))
 select printf('%d%02d_%02d%s', y, m, h, part) request_id, printf('era5_%d%02d_%02d%s.grib', y, m, h, part) filename, y::int "year", m::int "month", h::int hour_of_day, count(distinct day(TimeJD)) n_items, greatest(-90, min(lat) - 1) south, least(90, max(lat) + 1) north, greatest(-180, min(l) - 1) west, least(180, max(l) + 1) east, list_sort(list_distinct(list(day(TimeJD)::int))) "days", count(*) n_observations from p group by all""".replace("group by all", "group by y, m, h, part"))
def request_plan(spark, d):
    """One request per month and hour of day, cut in two where it spans more than half the globe; each reading is in one."""
    o = obs(spark, d).withColumns({"y": F.year("TimeJD"), "m": F.month("TimeJD"), "h": F.hour("TimeJD"), "l": lon180(F.col("lon"))})
    split = o.groupBy("y", "m", "h").agg((F.max("l") - F.min("l") > 180).alias("split"))
    p = o.join(split, ["y", "m", "h"]).withColumn("part", F.when(F.col("split"), F.when(F.col("l") < 0, "w").otherwise("e")).otherwise(""))
    g = p.groupBy("y", "m", "h", "part").agg(F.min("lat").alias("a"), F.max("lat").alias("b"), F.min("l").alias("x"), F.max("l").alias("z"), F.array_sort(F.collect_set(F.day("TimeJD"))).alias("days"), F.count("*").alias("n_observations"))
    clip = lambda c, lo, hi: F.greatest(F.lit(lo), F.least(F.lit(hi), c))
    named = [F.format_string(f, "y", "m", "h", "part").alias(n) for n, f in (("request_id", "%d%02d_%02d%s"), ("filename", "era5_%d%02d_%02d%s.grib"))]
    parts = [F.col("y").alias("year"), F.col("m").alias("month"), F.col("h").alias("hour_of_day"), F.size("days").cast("long").alias("n_items")]
    return g.select(*named, *parts, clip(F.col("a") - 1, -90.0, 90.0).alias("south"), clip(F.col("b") + 1, -90.0, 90.0).alias("north"), clip(F.col("x") - 1, -180.0, 180.0).alias("west"), clip(F.col("z") + 1, -180.0, 180.0).alias("east"), "days", "n_observations")


@query(f"select hour, l left_row_id, r right_row_id, round(dist, 6) distance_km, case when isfinite(x) then x end left_era5_t2m, case when isfinite(y) then y end right_era5_t2m from {SAMPLED_PAIRS}")
def same_hour_pairs(spark, d):
    """Sampled pairs of one hour's places with their distance: three of each row, in scrambled order."""
    e = era(spark, d).select("hour", "row_id", (F.col("iy") / 4.0).alias("lat"), (F.col("ix") / 4.0).alias("lon"), finite_or_null(F.col("era5_t2m").cast("double")).alias("era5_t2m"))
    return stats.sampled_pairs(e, "hour", "row_id", "lat", "lon", ["era5_t2m"]).withColumn("distance_km", r6("distance_km"))


@query(f"""with e as (select row_id, iy, ix, hour from {ERA}) select row_id, round(2 * 6371.0088 * asin(sqrt(least(1, pow(sin(radians(45 - iy / 4.0) / 2), 2) + cos(radians(iy / 4.0)) * cos(radians(45)) * pow(sin(radians(9 - ix / 4.0) / 2), 2)))), 5) km from e""")
def haversine(spark, d):
    """Distance of every grid row from (45, 9)."""
    return era(spark, d).select("row_id", F.round(haversine_km(F.col("iy") / 4.0, F.col("ix") / 4.0, F.lit(45.0), F.lit(9.0)), 5).alias("km"))


@query(f"""with p as (select row_id, latitude::double lat, ((longitude::double + 180) - 360 * floor((longitude::double + 180) / 360)) - 180 lon, epoch_us(hour) / 3.6e9 t from {ERA}),
 k as (select latitude::double lat, ((longitude::double + 180) - 360 * floor((longitude::double + 180) / 360)) - 180 lon, epoch_us(hour) / 3.6e9 t from {MATCHED} where latitude between -90 and 90 and isfinite(longitude) and hour is not null),
 a as (select avg(t) t0, stddev_pop(t) sd, 6371.0088 * pi() / 180 u, cos(radians(avg(lat))) c, stddev_pop(lon) sx, stddev_pop(lat) sy from k), s as (select *, (u * c * sx + u * sy) / 2 scale from a),
 d as (select distinct lon * u * c x, lat * u y, (t - t0) / sd * scale z from k, s), q as (select row_id, lon * u * c x, lat * u y, (t - t0) / sd * scale z from p, s)
 select row_id, round(sqrt(min(pow(q.x - d.x, 2) + pow(q.y - d.y, 2) + pow(q.z - d.z, 2))), 6) nearest_km from q, d group by 1""")
def nearest_neighbor_dist(spark, d):
    """For each grid row the distance to the nearest matched row in scaled space-time, however far it is."""
    at = {"lat": F.col("latitude").cast("double"), "lon": lon180(F.col("longitude")), "hours": micros(F.col("hour")) / 3.6e9}
    known = matched(spark, d).filter(F.col("latitude").between(-90, 90) & finite(F.col("longitude")) & F.col("hour").isNotNull()).select(*[c.alias(n) for n, c in at.items()])
    known = written(known, "matched")
    axes, side = nearest.space_time(known, "lat", "lon", "hours")
    points = era(spark, d).select("row_id", *[c.alias(n) for n, c in at.items()])
    out = nearest.nearest_distance(points.withColumns(axes), known.withColumns(axes), "row_id", list(axes), side)
    return out.select("row_id", r6("distance").alias("nearest_km"))


# --- sets ----------------------------------------------------------------------------------------------------------------


@query("select platform, TimeJD t, 'reading' part from clara_full union all select platform, fix_time, 'fix' from clara_track")
def union_all_parts(spark, d):
    a = table(spark, d, "clara_full").select("platform", F.col("TimeJD").alias("t"), F.lit("reading").alias("part"))
    return a.unionByName(table(spark, d, "clara_track").select("platform", F.col("fix_time").alias("t"), F.lit("fix").alias("part")))


@query("select distinct (TimeJD::date + unnest([-1, 0, 1]) * interval 1 day)::date as \"day\" from clara_full where TimeJD is not null")
def padded_days_union(spark, d):
    days = table(spark, d, "clara_full").filter("TimeJD is not null").select(F.col("TimeJD").cast("date").alias("day")).distinct()
    return days.select(F.explode(F.array(F.date_sub("day", 1), "day", F.date_add("day", 1))).alias("day")).distinct()


@query("select TimeJD::date as \"day\" from clara_full where TimeJD is not null intersect select fix_time::date from clara_track where fix_time is not null")
def days_intersect(spark, d):
    a = table(spark, d, "clara_full").filter("TimeJD is not null").select(F.col("TimeJD").cast("date").alias("day"))
    return a.intersect(table(spark, d, "clara_track").filter("fix_time is not null").select(F.col("fix_time").cast("date").alias("day")))


# --- order and limits -------------------------------------------------------------------------------------------------


@query("select hour, count(*) n from clara_era5_merged where hour is not null group by 1 order by hour limit 24")
def first_n_hours(spark, d):
    return table(spark, d, "clara_era5_merged").filter("hour is not null").groupBy("hour").agg(F.count("*").alias("n")).orderBy("hour").limit(24)


@query("select obs_id from (select obs_id, (((obs_id % 2147483648) * 2654435761) % 4294967296) s from clara_full) order by s, obs_id limit 500")
def hash_sample(spark, d):
    """A fixed sample of 500 rows without replacement, the same on every run and engine."""
    return table(spark, d, "clara_full").select("obs_id", stats.scrambled(F.col("obs_id")).alias("s")).orderBy("s", "obs_id").limit(500).select("obs_id")


@query("select load_id, variable, missing_rate from covariate_summary where missing_rate is not null and not isnan(missing_rate) order by missing_rate desc, load_id, variable limit 20")
def topk_features(spark, d):
    return table(spark, d, "covariate_summary").filter(finite(F.col("missing_rate"))).select("load_id", "variable", "missing_rate").orderBy(F.desc("missing_rate"), "load_id", "variable").limit(20)


# --- deduplication ----------------------------------------------------------------------------------------------------


@query("""select platform, TimeJD, obs_id, CLARA_radiance from (select *, row_number() over (partition by platform, TimeJD order by received_at, obs_id) rn from clara_full where platform is not null and TimeJD is not null and received_at is not null) where rn = 1""")
def dedup_first(spark, d):
    c = table(spark, d, "clara_full").filter("platform is not null and TimeJD is not null and received_at is not null").select("platform", "TimeJD", "received_at", "obs_id", "CLARA_radiance")
    return quality.first_of(c, ["platform", "TimeJD"], ["received_at", "obs_id"]).select("platform", "TimeJD", "obs_id", "CLARA_radiance")


@query("""select platform, TimeJD, count(*) n, min(CLARA_radiance) lo, max(CLARA_radiance) hi from clara_full where platform is not null and TimeJD is not null and isfinite(CLARA_radiance) group by 1, 2
 having count(*) > 1 and max(CLARA_radiance) - min(CLARA_radiance) > greatest(0.1, 0.001 * abs(avg(CLARA_radiance)))""")
def dedup_conflicts(spark, d):
    c = table(spark, d, "clara_full").filter("platform is not null and TimeJD is not null")
    return quality.conflicts(c, ["platform", "TimeJD"], "CLARA_radiance", 0.001, 0.1)


QUERIES, SQL = query.queries, query.sql
