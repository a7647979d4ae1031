"""Streaming queries over the given tables, replayed to their end.

Tumbling windows are held open for 40 days, longer than any row of these tables is late, then written once and dropped from
the state (append mode); at the end of a replay a closing row moves the watermark past the last window.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from skygrain.plans.registry import COVARIATES, Registry, long_sql
from skygrain.sources.tables import table
from skygrain.streaming import replay

query = Registry()


@query("""select date_trunc('hour', hour) window_start, cell_id, round(avg(clara_radiance_hourly_mean), 6) mean, count(*) n from clara_hourly_by_grid where hour is not null and isfinite(clara_radiance_hourly_mean) group by 1, 2""")
def stream_hourly_mean(spark, d):
    rows = table(spark, d, "clara_hourly_by_grid").select("cell_id", "hour", "clara_radiance_hourly_mean")
    means = lambda s: replay.windowed_mean(s, "hour", "clara_radiance_hourly_mean", ["cell_id"], "1 hour", "40 days")
    return replay.flushed(rows, "hour", means).withColumn("mean", F.round("mean", 6))


@query("select distinct event_type, user_id, ts from events where ts is not null")
def stream_dedup(spark, d):
    """Events once per type, user and time, within a watermark."""
    s = replay.source(spark, f"{d}/events.parquet").select("event_type", "user_id", "ts")
    return replay.replayed(replay.deduplicated(s, "ts", ["event_type", "user_id", "ts"], "400 days"))


@query(f"select variable, count(*) n_rows, count(*) filter (value is null) n_missing from {long_sql('hour', 'clara_era5_merged')} group by 1")
def stream_missingness(spark, d):
    return replay.replayed(replay.running_missingness(replay.source(spark, f"{d}/clara_era5_merged.parquet"), COVARIATES), "complete")


QUERIES, SQL = query.queries, query.sql
