"""Aggregations, distributions, missingness, calendars, autocorrelation, trends and spatial statistics over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skygrain.functions.exprs import finite, finite_or_null, hours, micros
from skygrain.operators import grid, quality, series, stats
from skygrain.plans.registry import COVARIATES, ERA, OBS, Registry, era, long_sql, obs
from skygrain.sources import files
from skygrain.sources.scratch import new_path, written
from skygrain.sources.tables import table

query = Registry()
r6 = lambda c: F.round(c, 6)
_day = lambda: F.col("TimeJD").cast("date")
HOUR = lambda c: F.date_trunc("hour", c).cast("timestamp_ntz")


# --- means and counts ----------------------------------------------------------------------------------------------------


@query(f"""select hour, iy, ix, round(avg(case when isfinite(era5_t2m) then era5_t2m::double end), 6) t2m, count(case when isfinite(era5_t2m) then 1 end) t2m_n, round(avg(case when isfinite(era5_sp) then era5_sp::double end), 6) sp,
 count(case when isfinite(era5_sp) then 1 end) sp_n, greatest(count(case when isfinite(era5_t2m) then 1 end), count(case when isfinite(era5_sp) then 1 end)) n_datapoints from {ERA} group by 1, 2, 3""")
def nanmean_per_hour(spark, d):
    x = lambda c: finite_or_null(F.col(c).cast("double"))
    return era(spark, d).groupBy("hour", "iy", "ix").agg(r6(F.avg(x("era5_t2m"))).alias("t2m"), F.count(x("era5_t2m")).alias("t2m_n"), r6(F.avg(x("era5_sp"))).alias("sp"), F.count(x("era5_sp")).alias("sp_n"), F.greatest(F.count(x("era5_t2m")), F.count(x("era5_sp"))).alias("n_datapoints"))


@query(f"""select platform, count(*) n, round(mod(24 + atan2(avg(sin(lt * 2 * pi() / 24)), avg(cos(lt * 2 * pi() / 24))) * 24 / (2 * pi()), 24), 4) mean_hour from {OBS} where platform is not null and isfinite(lt) group by 1""")
def circular_mean_hours(spark, d):
    o = obs(spark, d).filter(F.col("platform").isNotNull() & finite(F.col("lt")))
    return o.groupBy("platform").agg(F.count("*").alias("n"), F.round(grid.circular_mean(F.col("lt"), 24.0), 4).alias("mean_hour"))


@query(f"""select platform, orbit_leg, round(case when sqrt(pow(avg(sin(radians(lon))), 2) + pow(avg(cos(radians(lon))), 2)) < 1e-12 then median(lon) else mod(360 + degrees(atan2(avg(sin(radians(lon))), avg(cos(radians(lon))))), 360) end, 4) mean_lon
 from {OBS} where platform is not null and orbit_leg is not null group by 1, 2""")
def circular_mean_degrees(spark, d):
    o = obs(spark, d).filter("platform is not null and orbit_leg is not null")
    s, c = F.avg(F.sin(F.radians("lon"))), F.avg(F.cos(F.radians("lon")))
    mean = F.when(F.sqrt(s * s + c * c) < 1e-12, F.median("lon")).otherwise(grid.circular_mean(F.col("lon"), 360.0))
    return o.groupBy("platform", "orbit_leg").agg(F.round(mean, 4).alias("mean_lon"))


@query("""with n as (select platform, TimeJD::date as day, count(*) n from clara_full where platform is not null and TimeJD is not null group by 1, 2), e as (select platform, unnest(generate_series(min(day), max(day), interval 1 day))::date as day from n group by 1)
 select platform, day, coalesce(n, 0) n from e left join n using (platform, day)""")
def count_calendar_fill(spark, d):
    n = table(spark, d, "clara_full").filter("platform is not null and TimeJD is not null").groupBy("platform", _day().alias("day")).agg(F.count("*").alias("n"))
    every = n.groupBy("platform").agg(F.explode(F.sequence(F.min("day"), F.max("day"))).alias("day"))
    return every.join(n, ["platform", "day"], "left").fillna(0, ["n"])


@query(f"select date_trunc('hour', TimeJD) as hour, count(*) n, round(sum(v), 4) total, round(avg(v), 6) mean, round(median(v), 6) median, min(v) min, max(v) max from {OBS} group by 1")
def hourly_stats(spark, d):
    o = obs(spark, d).select(HOUR("TimeJD").alias("hour"), "v")
    g = o.groupBy("hour").agg(F.count("*").alias("n"), F.round(F.sum("v"), 4).alias("total"), r6(F.avg("v")).alias("mean"), F.min("v").alias("min"), F.max("v").alias("max"))
    return g.join(stats.percentiles(o, ["hour"], "v", {"median": 0.5}), "hour").withColumn("median", r6("median"))


@query(f"""select count(*) n_rows, count(distinct hour) n_hours, count(*) filter (clara_n_datapoints > 0) n_matched, coalesce(sum(clara_n_datapoints), 0)::bigint n_observations, round(count(*) filter (clara_n_datapoints > 0) / count(*), 6) match_rate,
 min(iy) / 4.0 lat_min, max(iy) / 4.0 lat_max from {ERA}""")
def matched_cell_summary(spark, d):
    m = F.count_if(F.col("clara_n_datapoints") > 0)
    return era(spark, d).agg(F.count("*").alias("n_rows"), F.count_distinct("hour").alias("n_hours"), m.alias("n_matched"), F.coalesce(F.sum("clara_n_datapoints"), F.lit(0)).alias("n_observations"), r6(m / F.count("*")).alias("match_rate"), (F.min("iy") / 4.0).alias("lat_min"), (F.max("iy") / 4.0).alias("lat_max"))


@query(f"""select round_even(lat / 10, 0)::bigint iy, round_even((lon - 360 * floor(lon / 360)) / 10, 0)::bigint % 36 ix, round(avg(v) + 1e-9, 6) mean, count(*) n, count(distinct date_trunc('hour', TimeJD)) n_hours from {OBS} group by 1, 2""")
def spatial_mean(spark, d):
    o = obs(spark, d).withColumns({"iy": grid.cell_index(F.col("lat"), 0.0, 10.0), "ix": grid.wrapped_index(F.col("lon"), 0.0, 10.0)})
    return o.groupBy("iy", "ix").agg(r6(F.avg("v") + 1e-9).alias("mean"), F.count("*").alias("n"), F.count_distinct(HOUR("TimeJD")).alias("n_hours"))


# --- distributions and missingness --------------------------------------------------------------------------------------

_P = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]
_PN = ["p01", "p05", "p25", "p50", "p75", "p95", "p99"]
_QUARTILES = [("q25", 0.25), ("median", 0.5), ("q75", 0.75)]
_QSQL = lambda x: ", ".join(f"round(quantile_cont({x}, {p}), 6) {n}" for p, n in zip(_P, _PN))


@query(f"""with c as (select case when isfinite(CLARA_radiance) then CLARA_radiance end x from clara_full)
 select 'linear' scale, count(x) n_used, count(*) - count(x) n_invalid, 0::bigint n_nonpositive, min(x) min, max(x) max, round(avg(x), 4) mean, round(stddev_samp(x), 4) std, {_QSQL('x')} from c
 union all select 'log', count(*) filter (x > 0), count(*) - count(x), count(*) filter (x <= 0), round(min(ln(x)) filter (x > 0), 6), round(max(ln(x)) filter (x > 0), 6), round(avg(ln(x)) filter (x > 0), 4), round(stddev_samp(ln(x)) filter (x > 0), 4), {_QSQL("case when x > 0 then ln(x) end")} from c""".replace("ln(x)", "ln(case when x > 0 then x end)"))
def radiance_summary(spark, d):
    """The whole table's distribution, linear and logarithmic, with exact percentiles; one pass for the figures of both."""
    x = finite_or_null(F.col("CLARA_radiance"))
    both = F.explode(F.array(F.struct(F.lit("linear").alias("scale"), x.alias("y")), F.struct(F.lit("log").alias("scale"), F.ln(F.when(x > 0, x)).alias("y")))).alias("s")
    c = table(spark, d, "clara_full").select(x.alias("x"), both).select("x", "s.*")
    log = F.col("scale") == "log"
    keep = lambda e: F.when(log, r6(e)).otherwise(e)
    g = c.groupBy("scale").agg(
        F.count("y").alias("n_used"), F.count_if(F.col("x").isNull()).alias("n_invalid"), F.count_if(log & (F.col("x") <= 0)).alias("n_nonpositive"),
        F.min("y").alias("min"), F.max("y").alias("max"), F.round(F.avg("y"), 4).alias("mean"), F.round(F.stddev_samp("y"), 4).alias("std"),
    )
    q = stats.percentiles(c, ["scale"], "y", dict(zip(_PN, _P)))
    return g.withColumns({"min": keep(F.col("min")), "max": keep(F.col("max"))}).join(q.select("scale", *[r6(n).alias(n) for n in _PN]), "scale", "left")


@query(f"""select variable, count(*) n_rows, count(*) - count(value) n_missing, count(*) filter (value = 0) n_zero, count(*) filter (value < 0) n_negative, count(*) filter (value > 0) n_positive, min(value) min, max(value) max, round(avg(value), 4) mean, round(stddev_samp(value), 4) std
 from {long_sql('hour', 'clara_era5_merged')} group by 1""")
def covariate_distribution(spark, d):
    g = stats.distribution(stats.melted(table(spark, d, "clara_era5_merged"), ["hour"], COVARIATES), ["variable"])
    return g.withColumns({"mean": F.round("mean", 4), "std": F.round("std", 4)})


@query(f"""select variable, round(count(*) filter (value = 0) / count(value), 6) zero_rate from {long_sql('hour', 'clara_era5_merged')} group by 1 having count(*) filter (value = 0) / count(value) > 0.3""")
def zero_heavy(spark, d):
    g = stats.distribution(stats.melted(table(spark, d, "clara_era5_merged"), ["hour"], COVARIATES), ["variable"])
    rate = F.col("n_zero") / (F.col("n_rows") - F.col("n_missing"))
    return g.filter(rate > 0.3).select("variable", r6(rate).alias("zero_rate")).orderBy(F.desc_nulls_last("zero_rate"))


@query(f"select variable, {_QSQL('value')} from {long_sql('hour', 'clara_era5_merged')} group by 1")
def sampled_quantiles(spark, d):
    """Exact quantiles of every covariate over all rows."""
    long = stats.melted(table(spark, d, "clara_era5_merged"), [], COVARIATES)
    q = stats.percentiles(long, ["variable"], "value", dict(zip(_PN, _P)))
    return q.select("variable", *[r6(n).alias(n) for n in _PN])


@query(f"select hour, variable, count(*) n_rows, count(*) filter (value is null) n_missing from {long_sql('hour', '(select * from clara_era5_merged where hour is not null)')} group by 1, 2")
def missingness_by_hour(spark, d):
    return stats.missingness(stats.melted(table(spark, d, "clara_era5_merged").filter("hour is not null"), ["hour"], COVARIATES), ["hour"])


@query(f"select iy, ix, variable, count(*) n_rows, count(*) filter (value is null) n_missing from {long_sql('iy, ix', ERA)} group by 1, 2, 3")
def missingness_by_location(spark, d):
    return stats.missingness(stats.melted(era(spark, d), ["iy", "ix"], COVARIATES), ["iy", "ix"])


@query(f"select load_id, variable, count(*) n_rows, count(*) filter (value is null) n_missing from {long_sql('load_id', '(select * from clara_era5_merged where load_id is not null)')} group by grouping sets ((load_id, variable), (variable), ())")
def missingness_grouping_sets(spark, d):
    long = stats.melted(table(spark, d, "clara_era5_merged").filter("load_id is not null"), ["load_id"], COVARIATES)
    return long.groupingSets([["load_id", "variable"], ["variable"], []], "load_id", "variable").agg(F.count("*").alias("n_rows"), F.count_if(F.col("value").isNull()).alias("n_missing"))


@query(f"select least(greatest(floor(v / 10), 0), 50)::bigint bin, count(*) n, round(avg(sign(v) * log10(1 + abs(v))), 6) log_modulus from {OBS} group by 1")
def histogram_bins(spark, d):
    v = F.col("v")
    return obs(spark, d).groupBy((F.width_bucket(v, F.lit(0.0), F.lit(500.0), F.lit(50)) - 1).cast("long").alias("bin")).agg(F.count("*").alias("n"), r6(F.avg(F.signum(v) * F.log10(1 + F.abs(v)))).alias("log_modulus"))


@query(f"select floor(lat / 15)::bigint lat_band, least(floor(v / 25), 19)::bigint v_bin, count(*) n, round(count(*) / sum(count(*)) over (), 9) share from {OBS} group by 1, 2")
def density_2d(spark, d):
    """Two-dimensional density: readings by band of latitude and bin of radiance."""
    g = obs(spark, d).groupBy(F.floor(F.col("lat") / 15).alias("lat_band"), F.least(F.floor(F.col("v") / 25), F.lit(19)).alias("v_bin")).agg(F.count("*").alias("n"))
    g = written(g, "density")
    return g.join(F.broadcast(g.agg(F.sum("n").alias("total")))).select("lat_band", "v_bin", "n", F.round(F.col("n") / F.col("total"), 9).alias("share"))  # one row


@query("select load_id, " + ", ".join(f"round(1 - count(case when isfinite({c}) then 1 end) / count(*), 6) {c}" for c in COVARIATES) + " from clara_era5_merged where load_id is not null group by 1")
def missingness_matrix(spark, d):
    """Missing rates as a matrix: one row per load, one column per covariate."""
    long = stats.missingness(stats.melted(table(spark, d, "clara_era5_merged").filter("load_id is not null"), ["load_id"], COVARIATES), ["load_id"])
    rate = long.select("load_id", "variable", r6(F.col("n_missing") / F.col("n_rows")).alias("rate"))
    return rate.groupBy("load_id").pivot("variable", COVARIATES).agg(F.max("rate"))


@query(f"select hour(TimeJD)::bigint hour_of_day, count(*) n, count(distinct platform) n_platforms from {OBS} group by 1")
def sampling_by_hour(spark, d):
    return obs(spark, d).groupBy(F.hour("TimeJD").cast("long").alias("hour_of_day")).agg(F.count("*").alias("n"), F.count_distinct("platform").alias("n_platforms"))


# --- calendars and series -------------------------------------------------------------------------------------------------


@query(f"""with e as (select TimeJD::date as day, count(*) n_samples, count(*) filter (isfinite(CLARA_radiance) and CLARA_radiance > 0 and CLARA_radiance <= 500) n_kept, {', '.join(f"round(quantile_cont(case when isfinite(CLARA_radiance) and CLARA_radiance > 0 and CLARA_radiance <= 500 then CLARA_radiance end, {p}), 6) {n}" for p, n in ((0.25, 'q25'), (0.5, 'median'), (0.75, 'q75')))} from clara_full where TimeJD is not null group by 1),
 c as (select unnest(generate_series(min(day), max(day), interval 1 day))::date as day from e) select day, coalesce(n_samples, 0) n_samples, coalesce(n_kept, 0) n_kept, q25, median, q75 from c left join e using (day)""")
def daily_quartiles(spark, d):
    kept = F.when(quality.in_range(F.col("CLARA_radiance")), F.col("CLARA_radiance"))
    c = table(spark, d, "clara_full").filter("TimeJD is not null").select(_day().alias("day"), kept.alias("v"))
    g = written(c.groupBy("day").agg(F.count("*").alias("n_samples"), F.count("v").alias("n_kept")), "days")
    q = stats.percentiles(c, ["day"], "v", dict(_QUARTILES)).select("day", *[r6(n).alias(n) for n, _ in _QUARTILES])
    return quality.calendar(g, "day").join(g, "day", "left").join(q, "day", "left").fillna(0, ["n_samples", "n_kept"])


@query(f"""with e as (select platform, orbit_leg, date_trunc('month', TimeJD)::date as month, count(*) n_samples, count(*) filter (isfinite(CLARA_radiance) and CLARA_radiance > 0 and CLARA_radiance <= 500) n_earth_view, count(distinct TimeJD::date) n_days,
 {', '.join(f"quantile_cont(case when isfinite(CLARA_radiance) and CLARA_radiance > 0 and CLARA_radiance <= 500 then CLARA_radiance end, {p}) {n}" for p, n in ((0.25, 'q25'), (0.5, 'median'), (0.75, 'q75')))} from clara_full where TimeJD is not null and platform is not null group by 1, 2, 3)
 select platform, orbit_leg, month, n_samples, n_earth_view, n_days, round(n_earth_view / n_samples, 6) earth_view_fraction, n_earth_view < 300 is_thin, {', '.join(f'case when n_earth_view >= 300 then round({c}, 6) end {c}' for c in ('q25', 'median', 'q75'))} from e""")
def monthly_quartiles(spark, d):
    """Quartiles per platform, leg and month; thin groups keep their counts and lose their quartiles."""
    kept = F.when(quality.in_range(F.col("CLARA_radiance")), F.col("CLARA_radiance"))
    c = table(spark, d, "clara_full").filter("TimeJD is not null and platform is not null")
    # A null leg is a group of its own, and joins know no nulls.
    c = c.select(F.struct("platform", F.coalesce("orbit_leg", F.lit("")).alias("leg"), F.trunc(_day(), "month").alias("month")).alias("g"), "orbit_leg", _day().alias("day"), kept.alias("v"))
    g = c.groupBy("g").agg(F.max("orbit_leg").alias("orbit_leg"), F.count("*").alias("n_samples"), F.count("v").alias("n_earth_view"), F.count_distinct("day").alias("n_days"))
    g = g.join(stats.percentiles(c, ["g"], "v", dict(_QUARTILES)), "g", "left")
    thin = F.col("n_earth_view") < 300
    quartiles = [F.when(~thin, r6(n)).alias(n) for n, _ in _QUARTILES]
    return g.select("g.platform", "orbit_leg", "g.month", "n_samples", "n_earth_view", "n_days", r6(F.col("n_earth_view") / F.col("n_samples")).alias("earth_view_fraction"), thin.alias("is_thin"), *quartiles)


def _resample_sql(bucket: str, step: str) -> str:
    return f"""with g as (select {bucket} period_start, count(*) n, round(avg(v), 6) mean, round(median(v), 6) median, round(stddev_samp(v), 6) std from {OBS} group by 1), c as (select unnest(generate_series(min(period_start), max(period_start), interval 1 {step}))::date period_start from g)
 select period_start, coalesce(n, 0) n, mean, median, std from c left join g using (period_start)"""


def _resampled(spark, d, rule):
    return series.resample(obs(spark, d), "TimeJD", "v", rule).withColumns({c: r6(c) for c in ("mean", "median", "std")})


@query(_resample_sql("TimeJD::date", "day"))
def resample_daily(spark, d):
    return _resampled(spark, d, "day")


@query(_resample_sql("(date_trunc('week', TimeJD::date - interval 1 day) + interval 7 day)::date", "week"))
def resample_weekly(spark, d):
    return _resampled(spark, d, "week")


@query(_resample_sql("date_trunc('month', TimeJD)::date", "month"))
def resample_monthly(spark, d):
    return _resampled(spark, d, "month")


@query(_resample_sql("date_trunc('year', TimeJD)::date", "year"))
def resample_yearly(spark, d):
    return _resampled(spark, d, "year")


@query("""with r as (select platform, TimeJD::date as day, count(*) n_olr, count(*) filter (isfinite(CLARA_geo_gap_seconds) or isfinite(CLARA_fov_latitude)) n_geolocated, count(*) filter (isfinite(CLARA_geo_gap_seconds)) n_earth_view,
 count(*) filter (isfinite(CLARA_fov_latitude)) n_valid, bool_and(coalesce(CLARA_radiance = 0, false)) and count(*) < 1000 dead from clara_full where TimeJD is not null and platform is not null group by 1, 2),
 c as (select platform, unnest(generate_series(min(day), max(day), interval 1 day))::date as day from r group by 1),
 j as (select platform, day, coalesce(n_olr, 0) n_olr, coalesce(n_geolocated, 0) n_geolocated, coalesce(n_earth_view, 0) n_earth_view, coalesce(n_valid, 0) n_valid, coalesce(dead, false) dead from c left join r using (platform, day))
 select * exclude (dead), case when dead then 'dead_olr' when n_olr = 0 then 'no_olr' when n_geolocated = 0 then 'no_geolocation' when n_earth_view = 0 then 'no_earth_view' when n_valid = 0 then 'gap_too_large' else 'ok' end status from j""")
def coverage_manifest(spark, d):
    """Counts and status of every platform for every day from its first to its last."""
    gap, lat = finite(F.col("CLARA_geo_gap_seconds")), finite(F.col("CLARA_fov_latitude"))
    c = table(spark, d, "clara_full").filter("TimeJD is not null and platform is not null").withColumn("day", _day())
    zeros = F.bool_and(F.coalesce(F.col("CLARA_radiance") == 0, F.lit(False)))
    r = c.groupBy("platform", "day").agg(F.count("*").alias("n_olr"), F.count_if(gap | lat).alias("n_geolocated"), F.count_if(gap).alias("n_earth_view"), F.count_if(lat).alias("n_valid"), (zeros & (F.count("*") < 1000)).alias("dead"))
    return quality.coverage(written(r, "days"), "platform", "day")


@query("""with n as (select TimeJD::date as day, count(*) n from clara_full where TimeJD is not null group by 1) select month(day)::bigint as month, count(*) filter (n > 0) n_days, sum(case when dayofmonth(day) <= 10 then n else 0 end)::bigint early, sum(case when dayofmonth(day) between 11 and 20 then n else 0 end)::bigint middle, sum(case when dayofmonth(day) > 20 then n else 0 end)::bigint late from n group by 1""")
def calendar_pivot(spark, d):
    n = table(spark, d, "clara_full").filter("TimeJD is not null").groupBy(_day().alias("day")).agg(F.count("*").alias("n"))
    third = F.when(F.day("day") <= 10, "early").when(F.day("day") <= 20, "middle").otherwise("late")
    base = n.withColumns({"third": third, "month": F.month("day").cast("long")})
    wide = base.groupBy("month").pivot("third", ["early", "middle", "late"]).agg(F.sum("n")).fillna(0)
    return wide.join(base.groupBy("month").agg(F.count("*").alias("n_days")), "month")


@query("""with s as (select cell_id, epoch_us(hour) - epoch_us(lag(hour) over (partition by cell_id order by hour)) g from (select distinct cell_id, hour from clara_hourly_by_grid where hour is not null)) select cell_id, round(median(g) / 1e6, 3) cadence_s from s where g is not null group by 1""")
def median_cadence(spark, d):
    h = table(spark, d, "clara_hourly_by_grid").filter("hour is not null").select("cell_id", micros(F.col("hour")).alias("t")).distinct()
    g = h.withColumn("g", F.col("t") - F.lag("t").over(Window.partitionBy("cell_id").orderBy("t"))).filter("g is not null")
    return g.groupBy("cell_id").agg(F.round(F.median("g") / 1e6, 3).alias("cadence_s"))


_ACF = lambda s, keys, n: f"""with s as {s}, p as (select {keys} a.i, l.lag, a.x x, b.x y from s a, (select unnest(range(0, {n} + 1)) lag) l, s b where {'a.k = b.k and ' if keys else ''} a.i = b.i + l.lag),
 g as (select {'k,' if keys else ''} lag, count(*) n_pairs, covar_pop(x, y) c, stddev_pop(x) sx, stddev_pop(y) sy, count(*) >= 6 and max(x) > min(x) and max(y) > min(y) ok from p group by {'k,' if keys else ''} lag)
 select {'k as cell_id,' if keys else ''} lag::bigint lag, n_pairs, case when ok then round(c / (sx * sy), 5) end autocorrelation, case when ok then round(1.96 / sqrt(n_pairs), 6) end band from g"""  # noqa: E731


@query(_ACF("(select TimeJD::date - date '1970-01-01' i, round(avg(v), 6) x from " + OBS + " group by 1)", "", 20))
def acf_daily(spark, d):
    s = obs(spark, d).groupBy(F.datediff(_day(), F.lit("1970-01-01").cast("date")).alias("i")).agg(r6(F.avg("v")).alias("x"))
    return series.autocorrelation(written(s, "daily"), "i", "x", 20).withColumns({"autocorrelation": F.round("autocorrelation", 5), "band": r6("band")})


@query(_ACF("(select cell_id k, floor(epoch_us(hour) / 3600000000)::bigint i, round(avg(clara_radiance_hourly_mean), 6) x from clara_hourly_by_grid where hour is not null and isfinite(clara_radiance_hourly_mean) group by 1, 2)", "a.k,", 12))
def temporal_acf_hourly(spark, d):
    s = table(spark, d, "clara_hourly_by_grid").filter(F.col("hour").isNotNull() & finite(F.col("clara_radiance_hourly_mean"))).groupBy("cell_id", hours(F.col("hour")).alias("i")).agg(r6(F.avg("clara_radiance_hourly_mean")).alias("x"))
    return series.autocorrelation(written(s, "hourly"), "i", "x", 12, ["cell_id"]).withColumns({"autocorrelation": F.round("autocorrelation", 5), "band": r6("band")})


_DAILY = f"(select TimeJD::date as day, avg(v) m from {OBS} group by 1)"
_YEARS = "((day - date '2025-10-01') / 365.25)"
_AT = "((epoch_us(TimeJD) - epoch_us(timestamp '2025-10-01')) / (365.25 * 86400 * 1e6))"


def _years(t):
    """Years of 365.25 days since the record's first day."""
    return (micros(t) - micros(F.expr("TIMESTAMP_NTZ'2025-10-01'"))) / (365.25 * 86400 * 1e6)


def _daily(spark, d):
    g = obs(spark, d).groupBy(_day().alias("day")).agg(F.avg("v").alias("m"))
    return g.withColumn("years", F.datediff("day", F.lit("2025-10-01").cast("date")) / 365.25)


@query(f"select count(*) n, round(regr_slope(m, {_YEARS}), 5) slope_per_year, round(regr_intercept(m, {_YEARS}), 5) intercept, round(regr_r2(m, {_YEARS}), 6) r2 from {_DAILY}")
def trend_fit(spark, d):
    t = series.trend(_daily(spark, d), F.col("years"), F.col("m"))
    return t.select("n", F.round("slope", 5).alias("slope_per_year"), F.round("intercept", 5).alias("intercept"), r6("r2").alias("r2"))


def _power_sql(fit: str, rows: str) -> str:
    """A parabola from power sums of (x, y), by determinants, as SQL."""
    return f"""select '{fit}' fit, 2::bigint as degree, n, c0, c1, c2, 1 - (yy - (c0 * m0 + c1 * m1 + c2 * m2)) / (yy - m0 * m0 / n) r2 from
 (select *, (m0 * (p2 * p4 - p3 * p3) - p1 * (m1 * p4 - p3 * m2) + p2 * (m1 * p3 - p2 * m2)) / det c0, (n * (m1 * p4 - p3 * m2) - m0 * (p1 * p4 - p3 * p2) + p2 * (p1 * m2 - m1 * p2)) / det c1,
  (n * (p2 * m2 - m1 * p3) - p1 * (p1 * m2 - m1 * p2) + m0 * (p1 * p3 - p2 * p2)) / det c2 from (select *, n * (p2 * p4 - p3 * p3) - p1 * (p1 * p4 - p3 * p2) + p2 * (p1 * p3 - p2 * p2) det from
  (select count(*) n, sum(x) p1, sum(x * x) p2, sum(x ** 3) p3, sum(x ** 4) p4, sum(y) m0, sum(x * y) m1, sum(x * x * y) m2, sum(y * y) yy from {rows})))"""


@query(f"""select fit, degree, n, round(c0, 3) c0, round(c1, 2) c1, round(c2, 1) c2, round(r2, 5) r2 from ({_power_sql('daily', f"(select {_YEARS} x, m y from {_DAILY})")} union all {_power_sql('observations', f"(select {_AT} x, v y from {OBS})")})""")
def trend_polynomial(spark, d):
    """Parabolas through the daily means and through the observations themselves."""
    rows = []
    o = obs(spark, d)
    for fit, df, x, y in (("daily", _daily(spark, d), F.col("years"), F.col("m")), ("observations", o, _years(F.col("TimeJD")), F.col("v"))):
        p = series.polynomial(df, x, y, 2)
        rows.append((fit, 2, p["n"], *p["coefficients"], p["r2"]))
    out = spark.createDataFrame(rows, "fit string, degree long, n long, c0 double, c1 double, c2 double, r2 double")
    return out.withColumns({"c0": F.round("c0", 3), "c1": F.round("c1", 2), "c2": F.round("c2", 1), "r2": F.round("r2", 5)})


@query(f"with t as (select regr_slope(m, {_YEARS}) s, regr_intercept(m, {_YEARS}) c from {_DAILY}) select day, round(m - c - s * {_YEARS}, 5) residual from {_DAILY}, t")
def detrended(spark, d):
    g = _daily(spark, d)
    t = series.trend(g, F.col("years"), F.col("m"))
    return g.join(F.broadcast(t)).select("day", F.round(F.col("m") - F.col("intercept") - F.col("slope") * F.col("years"), 5).alias("residual"))  # one row


_RULES = {
    "day": ("(TimeJD::date - date '1970-01-01')", lambda t: F.datediff(t.cast("date"), F.lit("1970-01-01").cast("date"))),
    "week": ("floor((TimeJD::date - date '1970-01-06') / 7.0)", lambda t: F.floor(F.datediff(t.cast("date"), F.lit("1970-01-06").cast("date")) / 7)),
    "month": ("(year(TimeJD) * 12 + month(TimeJD))", lambda t: F.year(t) * 12 + F.month(t)),
    "year": ("year(TimeJD)", lambda t: F.year(t)),
}
_RESIDUALS = f"""(select rule k, i, round(avg(r), 6) x from (select unnest([{', '.join(f"'{k}'" for k in _RULES)}]) rule, unnest([{', '.join(f'{sql}::bigint' for sql, _ in _RULES.values())}]) i, v - c - s * {_AT} r
 from {OBS}, (select regr_slope(m, {_YEARS}) s, regr_intercept(m, {_YEARS}) c from {_DAILY})) group by 1, 2)"""


@query(_ACF(_RESIDUALS, "a.k,", 20).replace("k as cell_id", "k as rule"))
def acf_residuals(spark, d):
    """Autocorrelation of the mean residuals of days, weeks (Tuesday to Monday), months and years about the daily trend."""
    t = series.trend(_daily(spark, d), F.col("years"), F.col("m"))
    o = obs(spark, d).join(F.broadcast(t))  # one row
    residual = (F.col("v") - F.col("intercept") - F.col("slope") * _years(F.col("TimeJD"))).alias("r")
    rules = F.array(*[F.struct(F.lit(k).alias("rule"), f(F.col("TimeJD")).cast("long").alias("i")) for k, (_, f) in _RULES.items()])
    s = o.select(residual, F.explode(rules).alias("b")).groupBy("b.rule", "b.i").agg(r6(F.avg("r")).alias("x"))
    return series.autocorrelation(written(s, "residuals"), "i", "x", 20, ["rule"]).withColumns({"autocorrelation": F.round("autocorrelation", 5), "band": r6("band")})


@query("select row_id, strftime(hour, '%Y%m%dT%H%M%S') stamp, year(hour)::int y, month(hour)::int mo, dayofyear(hour)::int doy, hour(hour)::int h from clara_era5_merged where hour is not null")
def date_parts(spark, d):
    return table(spark, d, "clara_era5_merged").filter("hour is not null").select("row_id", F.date_format("hour", "yyyyMMdd'T'HHmmss").alias("stamp"), F.year("hour").alias("y"), F.month("hour").alias("mo"), F.dayofyear("hour").alias("doy"), F.hour("hour").alias("h"))


@query("select obs_id, strftime(TimeJD, '%Y-%m-%d %H:%M:%S') stamp, strptime(strftime(TimeJD, '%Y-%m-%d %H:%M:%S'), '%Y-%m-%d %H:%M:%S') back from clara_full where TimeJD is not null")
def format_ts(spark, d):
    stamp = F.date_format("TimeJD", "yyyy-MM-dd HH:mm:ss")
    return table(spark, d, "clara_full").filter("TimeJD is not null").select("obs_id", stamp.alias("stamp"), F.to_timestamp_ntz(stamp, F.lit("yyyy-MM-dd HH:mm:ss")).alias("back"))


@query("select obs_id, round((epoch_us(TimeJD) - epoch_us(timestamp '2025-01-01')) / (365.25 * 86400 * 1e6), 9) \"years\" from clara_full where TimeJD is not null")
def decimal_years(spark, d):
    t = micros(F.col("TimeJD")) - micros(F.expr("TIMESTAMP_NTZ'2025-01-01'"))
    return table(spark, d, "clara_full").filter("TimeJD is not null").select("obs_id", F.round(t / (365.25 * 86400 * 1e6), 9).alias("years"))


@query("select load_id, regexp_extract(source_file, '_(\\d{6})\\d{2}_(\\d{2})', 1) as month, regexp_extract(source_file, '_(\\d{6})\\d{2}_(\\d{2})', 2) as hour, count(*) n from clara_era5_merged where source_file is not null group by all".replace("group by all", "group by 1, 2, 3"))
def regex_month(spark, d):
    e = table(spark, d, "clara_era5_merged").filter("source_file is not null")
    at = lambda i: F.regexp_extract("source_file", r"_(\d{6})\d{2}_(\d{2})", i)
    return e.groupBy("load_id", at(1).alias("month"), at(2).alias("hour")).agg(F.count("*").alias("n"))


# --- places ---------------------------------------------------------------------------------------------------------------


@query(f"select obs_id, round(6371.0088 * radians((lon - 9) - 360 * floor(((lon - 9) + 180) / 360)) * cos(radians(45)), 5) x_km, round(6371.0088 * radians(lat - 45), 5) y_km from {OBS}")
def project_km(spark, d):
    """Equirectangular kilometres about (45, 9), with the difference of longitude wrapped."""
    turn = F.pmod(F.col("lon") - 9 + 180, F.lit(360.0)) - 180
    return obs(spark, d).select("obs_id", F.round(F.lit(6371.0088) * F.radians(turn) * F.cos(F.radians(F.lit(45.0))), 5).alias("x_km"), F.round(F.lit(6371.0088) * F.radians(F.col("lat") - 45), 5).alias("y_km"))


_XYZ = "cos(radians(lat)) * cos(radians(lon)) x, cos(radians(lat)) * sin(radians(lon)) y, sin(radians(lat)) z"


@query(f"with u as (select obs_id, {_XYZ} from {OBS}) select obs_id, round(x, 6) + 0.0 x, round(y, 6) + 0.0 y, round(z, 6) + 0.0 z, round(degrees(asin(greatest(-1, least(1, z)))), 5) + 0.0 lat, round(degrees(atan2(y, x)), 5) + 0.0 lon from u where abs(lat) < 89.9".replace("from u where abs(lat) < 89.9", "from u"))
def unit_vector(spark, d):
    la, lo = F.radians("lat"), F.radians("lon")
    u = obs(spark, d).select("obs_id", (F.cos(la) * F.cos(lo)).alias("x"), (F.cos(la) * F.sin(lo)).alias("y"), F.sin(la).alias("z"))
    r5 = lambda c: F.round(c, 5) + 0.0
    return u.select("obs_id", *[(r6(c) + 0.0).alias(c) for c in "xyz"], r5(F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("z")))))).alias("lat"), r5(F.degrees(F.atan2("y", "x"))).alias("lon"))


@query(f"with u as (select obs_id, {_XYZ} from {OBS}) select obs_id, round(x, 9) + 0.0 x, round(y, 9) + 0.0 y, round(z, 9) + 0.0 z from u")
def parse_triple(spark, d):
    """Positions delivered as text "(x,y,z)", read again and split; a text with other than two commas is an error."""
    path = new_path(spark, "triples")
    obs(spark, d).select("obs_id", files.unit_triple(F.col("lat"), F.col("lon")).alias("position")).write.option("header", True).csv(path)
    t = spark.read.schema("obs_id long, position string").option("header", True).csv(path).withColumn("p", files.triple(F.col("position")))
    return t.select("obs_id", *[(F.round(F.col("p")[i], 9) + 0.0).alias(c) for i, c in enumerate("xyz")])


@query(f"""select 'scalar' delivery, obs_id, round(lat, 5) + 0.0 lat, round(lon, 5) + 0.0 lon from {OBS} union all
 select 'unit', obs_id, round(lat, 5) + 0.0, round(((lon + 180) - 360 * floor((lon + 180) / 360)) - 180, 5) + 0.0 from {OBS}""")
def vector_to_degrees(spark, d):
    """Two deliveries of the positions as text, scalars in parentheses and unit vectors; each decides by all its rows which it is."""
    path = new_path(spark, "positions")
    o = obs(spark, d)
    one = lambda c: F.concat(F.lit("("), F.col(c).cast("string"), F.lit(",0,0)"))
    both = unit = files.unit_triple(F.col("lat"), F.col("lon"))
    o.select(F.lit("scalar").alias("delivery"), "obs_id", one("lat").alias("lat"), one("lon").alias("lon")).unionByName(
        o.select(F.lit("unit").alias("delivery"), "obs_id", both.alias("lat"), unit.alias("lon"))
    ).write.partitionBy("delivery").option("header", True).csv(path)
    r5 = lambda c: (F.round(c, 5) + 0.0).alias(c)
    parts = []
    for name in ("scalar", "unit"):
        raw = spark.read.schema("obs_id long, lat string, lon string").option("header", True).csv(f"{path}/delivery={name}")
        degrees = files.positions(raw.withColumns({c: files.triple(F.col(c)) for c in ("lat", "lon")}), "lat", "lon")
        parts.append(degrees.select(F.lit(name).alias("delivery"), "obs_id", r5("lat"), r5("lon")))
    return parts[0].unionByName(parts[1])


_MATCHED = "(select row_id, clara_radiance_hourly_mean::double y, * from clara_era5_merged where isfinite(clara_radiance_hourly_mean))"


def _matched_long(spark, d):
    e = table(spark, d, "clara_era5_merged").filter(finite(F.col("clara_radiance_hourly_mean"))).withColumn("y", F.col("clara_radiance_hourly_mean").cast("double"))
    return stats.melted(e, ["row_id", "y"], COVARIATES).filter("value is not null")


@query(f"select variable, count(*) n, case when count(*) >= 20 and max(value) > min(value) and max(y) > min(y) then round(covar_pop(value, y) / (stddev_pop(value) * stddev_pop(y)), 6) end pearson from {long_sql('y', _MATCHED.replace('row_id, ', ''))} where value is not null group by 1")
def covariate_correlation(spark, d):
    return _matched_long(spark, d).groupBy("variable").agg(F.count("*").alias("n"), r6(stats.guarded_corr("value", "y")).alias("pearson"))


@query(f"select variable, {_QSQL('value')} from {long_sql('y', _MATCHED.replace('row_id, ', ''))} where value is not null group by 1")
def covariate_quantiles(spark, d):
    """Exact quantiles of every covariate over the matched rows."""
    q = stats.percentiles(_matched_long(spark, d), ["variable"], "value", dict(zip(_PN, _P)))
    return q.select("variable", *[r6(n).alias(n) for n in _PN])


@query(f"""with r as (select variable, rank() over (partition by variable order by value) + (count(*) over (partition by variable, value) - 1) / 2.0 a, rank() over (partition by variable order by y) + (count(*) over (partition by variable, y) - 1) / 2.0 b from {long_sql('y', _MATCHED.replace('row_id, ', ''))} where value is not null)
 select variable, count(*) n, case when count(*) >= 20 and max(a) > min(a) and max(b) > min(b) then round(corr(a, b), 6) end spearman from r group by 1""")
def spearman_vs_target(spark, d):
    long = written(_matched_long(spark, d), "matched")
    ranks = stats.ranked(stats.ranked(long, ["variable"], "value", "a"), ["variable"], "y", "b")
    return ranks.groupBy("variable").agg(F.count("*").alias("n"), r6(stats.guarded_corr("a", "b")).alias("spearman"))




@query(f"""with m as (select row_id, variable, value from {long_sql('row_id', '(select * from clara_era5_merged where isfinite(clara_radiance_hourly_mean))', COVARIATES)} where value is not null),
 p as (select a.variable va, b.variable vb, a.value x, b.value y from m a join m b on a.row_id = b.row_id and a.variable < b.variable), r as (select va, vb, rank() over (partition by va, vb order by x) + (count(*) over (partition by va, vb, x) - 1) / 2.0 a, rank() over (partition by va, vb order by y) + (count(*) over (partition by va, vb, y) - 1) / 2.0 b from p)
 select va, vb, count(*) n, case when count(*) >= 20 and max(a) > min(a) and max(b) > min(b) then round(corr(a, b), 6) end spearman from r group by 1, 2""")
def spearman_matrix(spark, d):
    """Rank correlation of every two covariates on the rows that have both; the pairs come from one row's array."""
    e = table(spark, d, "clara_era5_merged").filter(finite(F.col("clara_radiance_hourly_mean")))
    x = {c: finite_or_null(F.col(c).cast("double")) for c in COVARIATES}
    two = [(a, b) for a in COVARIATES for b in COVARIATES if a < b]
    p = e.select(F.explode(F.array(*[F.struct(F.lit(a).alias("va"), F.lit(b).alias("vb"), x[a].alias("x"), x[b].alias("y")) for a, b in two])).alias("p")).select("p.*").filter("x is not null and y is not null")
    p = written(p, "variable-pairs")
    ranks = stats.ranked(stats.ranked(p, ["va", "vb"], "x", "a"), ["va", "vb"], "y", "b")
    return ranks.groupBy("va", "vb").agg(F.count("*").alias("n"), r6(stats.guarded_corr("a", "b")).alias("spearman"))


SAMPLED_PAIRS = f"""(with e as (select row_id, hour, iy / 4.0 lat, ix / 4.0 lon, era5_t2m::double v, (((row_id % 2147483648) * 2654435761) % 4294967296) s from {ERA}), k as (select *, lead(row_id, 1) over w n1, lead(row_id, 2) over w n2, lead(row_id, 3) over w n3 from (select e.*, floor(s * c / 4294967296.0) bucket from e join (select hour, ceil(count(*) / 4096.0) c from e group by 1) using (hour)) window w as (partition by hour, bucket order by s, row_id)),
 p as (select row_id l, unnest([n1, n2, n3]) r from k)
 select 2 * 6371.0088 * asin(sqrt(least(1, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) dist, a.v x, b.v y, l, r, a.hour from p join e a on a.row_id = l join e b on b.row_id = r)"""


def _pairs(spark, d):
    e = era(spark, d).select("hour", "row_id", (F.col("iy") / 4.0).alias("lat"), (F.col("ix") / 4.0).alias("lon"), F.col("era5_t2m").cast("double").alias("v"))
    return stats.sampled_pairs(e, "hour", "row_id", "lat", "lon", ["v"])


_BINNED = f"(select *, least(floor(dist / (top / 12)), 11)::bigint bin from (select *, max(dist) over () top, count(*) over () total from {SAMPLED_PAIRS} where isfinite(x) and isfinite(y)) where total >= 50 and top > 0)"


def _by_twelfths(spark, d):
    """Pairs with both values in twelve bins of equal width up to the greatest distance; none below 50 pairs."""
    p = _pairs(spark, d).filter(finite(F.col("left_v")) & finite(F.col("right_v")))
    top = p.agg(F.max("distance_km"), F.count("*")).first()
    if top[1] < 50 or not top[0]:
        p = p.limit(0)
    return stats.by_distance(p, "v", (top[0] or 12.0) / 12, 12)


@query(f"select bin, count(*) n_pairs, round(avg(dist), 4) mean_distance_km, round(avg(pow(x - y, 2)) / 2, 5) semivariance from {_BINNED} group by 1 having count(*) >= 10")
def variogram(spark, d):
    g = _by_twelfths(spark, d)
    return g.select("bin", "n_pairs", F.round("mean_distance_km", 4).alias("mean_distance_km"), F.round("semivariance", 5).alias("semivariance"))


@query(f"select bin, count(*) n_pairs, case when max(x) > min(x) and max(y) > min(y) then round(covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)), 5) end correlation from {_BINNED} group by 1 having count(*) >= 10")
def spatial_autocorr(spark, d):
    return _by_twelfths(spark, d).select("bin", "n_pairs", F.round("correlation", 5).alias("correlation"))


@query(f"select count(*) n_pairs, round(quantile_cont(dist, 0.1), 4) p10, round(quantile_cont(dist, 0.5), 4) p50, round(quantile_cont(dist, 0.9), 4) p90 from {SAMPLED_PAIRS}")
def pair_distance_quantile(spark, d):
    p = _pairs(spark, d).select("distance_km")
    q = stats.percentiles(p, [], "distance_km", {"p10": 0.1, "p50": 0.5, "p90": 0.9})
    return q.join(F.broadcast(p.agg(F.count("*").alias("n_pairs")))).select("n_pairs", *[F.round(c, 4).alias(c) for c in ("p10", "p50", "p90")])  # one row


QUERIES, SQL = query.queries, query.sql
