"""The queries of the problems tagged llm (2, 5, 6, 8, 9 and 10) over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skygrain.functions.exprs import finite, lon180
from skygrain.llm import asof_stream, bpe, chunking, mixing, quantiles, splits
from skygrain.sources.scratch import written
from skygrain.sources.tables import table


def _without(c: str):
    return F.col(c).isNull() | F.isnan(c)


def _same(platform: str):
    return F.lower(F.trim(F.col(platform)))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = table(spark, sf_dir, "clara_full").filter(_without("CLARA_fov_latitude") | _without("CLARA_fov_longitude"))
    right = table(spark, sf_dir, "clara_track").filter(~_without("latitude") & ~_without("longitude"))
    left = asof_stream.event_rows(left, _same("platform"), F.col("TimeJD"), F.col("obs_id"))
    right = asof_stream.event_rows(right, _same("platform"), F.col("fix_time"), F.col("fix_id"))
    return asof_stream.nearest(left, right, 4_000_000).select(F.col("key").alias("obs_id"), F.col("right_key").alias("fix_id"))


def _folds(spark: SparkSession, sf_dir: str):
    f = table(spark, sf_dir, "fold_assignments")
    here = finite(F.col("latitude")) & finite(F.col("longitude"))
    place = {"key_a": F.when(here, F.round(F.col("latitude").cast("double") * 4)).cast("long"), "key_b": F.when(here, F.round(lon180(F.col("longitude")) * 4)).cast("long")}
    day = {"key_a": F.datediff(F.col("hour").cast("date"), F.lit("1970-01-01").cast("date")).cast("long"), "key_b": F.when(F.col("hour").isNotNull(), F.lit(0)).cast("long")}
    return f, place, day


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, place, day = _folds(spark, sf_dir)
    return splits.divided(f, {"space": (place, F.col("space_fold")), "time": (day, F.col("time_fold"))})


P5_WEIGHTS = {"train": 0.8, "validation": 0.1, "test": 0.1}


def p5_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, place, day = _folds(spark, sf_dir)
    return splits.assigned(f, "row_id", splits.node("space", *place.values()), splits.node("time", *day.values()), P5_WEIGHTS)


def p5_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records, and the share of them, per kind of split."""
    s = written(p5_splits(spark, sf_dir), "splits")
    kinds = F.explode(F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).alias("split")) for c in ("split", "first_split", "second_split", "blocked_split")])).alias("k")
    n = s.select(kinds).select("k.*").groupBy("kind", "split").agg(F.count("*").alias("n_records"))
    return n.join(n.groupBy("kind").agg(F.sum("n_records").alias("total")), "kind").select("kind", "split", "n_records", (F.col("n_records") / F.col("total")).alias("share"))


_P6 = ["platform", "orbit_leg", "month"]


def _p6_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("CLARA_radiance")
    rows = table(spark, sf_dir, "clara_full").filter("TimeJD is not null and platform is not null").filter((v > 0) & (v <= 500))
    rows = rows.select("platform", "orbit_leg", F.date_format("TimeJD", "yyyy-MM").alias("month"), "CLARA_radiance")
    return quantiles.counts(rows, _P6, v)


def p6_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantiles.select(_p6_counts(spark, sf_dir), _P6, [0.25, 0.5]).withColumn("value", F.round("value", 6))


def p6_joined_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quartiles per platform over all months, from the months' value counts."""
    return quantiles.select(quantiles.merged([_p6_counts(spark, sf_dir)], ["platform"]), ["platform"], [0.25, 0.5, 0.75]).withColumn("value", F.round("value", 6))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    exact = quantiles.select(_p6_counts(spark, sf_dir), _P6, [0.25, 0.5])
    said = table(spark, sf_dir, "clara_monthly_summary").select("platform", "orbit_leg", F.date_format("month", "yyyy-MM").alias("month"), F.explode(F.array(F.struct(F.lit(0.25).alias("p"), F.col("q25").alias("said")), F.struct(F.lit(0.5).alias("p"), F.col("median").alias("said")))).alias("r"))
    said = said.select(*_P6, "r.p", "r.said").filter("said is not null and not isnan(said)")
    both = said.join(exact, [*_P6, "p"])
    return both.filter(F.abs(F.col("said") - F.col("value")) > 0.02 * F.col("value")).select(*_P6).distinct()


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), "doc_id", "text")


def _mix(spark: SparkSession, sf_dir: str):
    targets = table(spark, sf_dir, "mix_targets")
    listed = targets.filter("source is not null").select("source").distinct()
    sizes = mixing.sized(table(spark, sf_dir, "documents"), "doc_id", "text", "source", listed)
    return *mixing.schedule(sizes, targets), sizes


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_shares(spark, sf_dir).filter("short").select("mix_id", "source")


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan, slots, _ = _mix(spark, sf_dir)
    return mixing.report(plan, slots)


def p9_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.drawn(*_mix(spark, sf_dir))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a second piece."""
    return chunking.cuts(table(spark, sf_dir, "documents"), "doc_id", "text").filter("piece = 1").select("doc_id")


def p10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.pieces(table(spark, sf_dir, "documents"), "doc_id", "text")


QUERIES = {
    "p2_found": p2_found, "p5_found": p5_found, "p5_splits": p5_splits, "p5_sizes": p5_sizes, "p6_found": p6_found, "p6_quantiles": p6_quantiles,
    "p6_joined_months": p6_joined_months, "p8_ids": p8_ids, "p9_found": p9_found, "p9_shares": p9_shares, "p9_schedule": p9_schedule, "p10_found": p10_found, "p10_pieces": p10_pieces,
}
_GROUPS = "(select platform, orbit_leg, strftime(TimeJD, '%Y-%m') as month, CLARA_radiance v from clara_full where TimeJD is not null and platform is not null and isfinite(CLARA_radiance) and CLARA_radiance > 0 and CLARA_radiance <= 500)"
SQL: dict[str, str] = {
    "p2_found": """with l as (select obs_id, lower(trim(platform)) p, TimeJD t from clara_full where platform is not null and TimeJD is not null and (CLARA_fov_latitude is null or isnan(CLARA_fov_latitude) or CLARA_fov_longitude is null or isnan(CLARA_fov_longitude))),
 r as (select fix_id, lower(trim(platform)) p, fix_time ft from clara_track where platform is not null and fix_time is not null and latitude is not null and not isnan(latitude) and longitude is not null and not isnan(longitude)),
 j as (select obs_id, fix_id, row_number() over (partition by obs_id order by abs(epoch_us(t) - epoch_us(ft)), fix_id) rn from l join r on l.p = r.p and ft between t - interval 4 second and t + interval 4 second) select obs_id, fix_id from j where rn = 1""",
    "p5_found": """with f as (select round(latitude::double * 4)::bigint a, round(((longitude::double + 180) - 360 * floor((longitude::double + 180) / 360) - 180) * 4)::bigint b, space_fold, time_fold, datediff('day', date '1970-01-01', hour::date)::bigint d from fold_assignments)
 select 'space' axis, a key_a, b key_b from f where a is not null and b is not null group by 2, 3 having count(distinct space_fold) > 1 union all select 'time', d, 0::bigint from f where d is not null group by 2 having count(distinct time_fold) > 1""",
    "p6_found": f"""with g as (select platform, orbit_leg, month, quantile_cont(v, 0.25) q, quantile_cont(v, 0.5) h from {_GROUPS} group by 1, 2, 3)
 select distinct s.platform, s.orbit_leg, g.month from clara_monthly_summary s join g on s.platform = g.platform and s.orbit_leg = g.orbit_leg and strftime(s.month, '%Y-%m') = g.month where (not isnan(q25) and abs(q25 - q) > 0.02 * q) or (not isnan(median) and abs(median - h) > 0.02 * h)""",
    "p6_quantiles": f"select platform, orbit_leg, month, unnest([0.25, 0.5])::double p, round(unnest([quantile_cont(v, 0.25), quantile_cont(v, 0.5)]), 6) as \"value\", count(*) n from {_GROUPS} group by 1, 2, 3",
    "p6_joined_months": f"select platform, unnest([0.25, 0.5, 0.75])::double p, round(unnest([quantile_cont(v, 0.25), quantile_cont(v, 0.5), quantile_cont(v, 0.75)]), 6) as \"value\", count(*) n from {_GROUPS} group by 1",
}
