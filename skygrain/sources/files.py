"""Readers of raw deliveries: positional CSV, Julian days, inventories of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skygrain.functions.exprs import finite


def csv_by_position(spark: SparkSession, path: str, positions: list[int], names: list[str], null: str = "", header: bool = True) -> DataFrame:
    """CSV columns taken by position, as strings, whatever the header calls them."""
    width = max(positions) + 1
    schema = ", ".join(f"_{i} string" for i in range(width))
    raw = spark.read.schema(schema).option("header", header).option("enforceSchema", True).option("nullValue", null).csv(path)
    return raw.select(*[F.col(f"_{i}").alias(n) for i, n in zip(positions, names)])


def julian_to_timestamp(day: Column) -> Column:
    """A Julian Day (a double, from noon) as a timestamp without zone, to the microsecond."""
    us = F.round((day - 2440587.5) * 86_400_000_000.0).cast("long")
    return F.timestamp_add("MICROSECOND", us, F.expr("TIMESTAMP_NTZ'1970-01-01'"))


def unit_triple(lat: Column, lon: Column) -> Column:
    """A position as the text "(x,y,z)" of its unit vector."""
    la, lo = F.radians(lat), F.radians(lon)
    return F.concat(F.lit("("), F.concat_ws(",", *[c.cast("string") for c in (F.cos(la) * F.cos(lo), F.cos(la) * F.sin(lo), F.sin(la))]), F.lit(")"))


def triple(text: Column) -> Column:
    """The three numbers of "(x,y,z)"; a text with other than two commas is an error, null stays null."""
    parts = F.split(F.regexp_replace(F.trim(text), r"^\(+|\)+$", ""), ",")
    return F.when(text.isNull(), F.lit(None)).when(F.size(parts) == 3, F.transform(parts, lambda x: F.trim(x).cast("double"))).otherwise(F.raise_error(F.concat(F.lit("not an (x,y,z) triple: "), text)))


def encoding(df: DataFrame, lat: str, lon: str) -> DataFrame:
    """One row (scalar, unit): which forms all triples of both columns have. A vector of length 0 stands for no position."""
    rest = lambda c: (F.col(c)[1] == 0) & (F.col(c)[2] == 0)
    norm = lambda c: F.sqrt(F.col(c)[0] ** 2 + F.col(c)[1] ** 2 + F.col(c)[2] ** 2)
    near = lambda c: F.when(finite(norm(c)) & (norm(c) > 0), F.abs(norm(c) - 1) <= 1e-3)
    yes = lambda a, b: F.coalesce(F.bool_and(a), F.lit(True)) & F.coalesce(F.bool_and(b), F.lit(True))
    return df.agg(yes(rest(lat), rest(lon)).alias("scalar"), yes(near(lat), near(lon)).alias("unit"))


def positions(df: DataFrame, lat: str, lon: str) -> DataFrame:
    """df with its two columns of triples as degrees, whether these are scalars in parentheses or unit vectors; else an error."""
    form = encoding(df, lat, lon).first()
    if form["scalar"]:
        return df.withColumns({lat: F.col(lat)[0], lon: F.col(lon)[0]})
    if not form["unit"]:
        raise ValueError("positions are neither scalars in parentheses nor unit vectors")
    norm = F.sqrt(F.col(lat)[0] ** 2 + F.col(lat)[1] ** 2 + F.col(lat)[2] ** 2)
    up = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col(lat)[2] / norm))
    there = finite(norm) & (norm > 0)
    return df.withColumns({lat: F.when(there, F.degrees(F.asin(up))), lon: F.when(there, F.degrees(F.atan2(F.col(lon)[1], F.col(lon)[0])))})


def delivered(names: DataFrame, version: str) -> DataFrame:
    """(day, delivery): of each day the delivery of the wanted version, else the only one there is; several others are an error."""
    n = names.select("delivery", F.regexp_extract("delivery", r"_(\d{8})_", 1).alias("day")).distinct()
    g = n.groupBy("day").agg(F.max(F.when(F.col("delivery").endswith("_" + version), F.col("delivery"))).alias("exact"), F.count("*").alias("n"), F.min("delivery").alias("one"))
    other = F.when(F.col("n") == 1, F.col("one")).otherwise(F.raise_error(F.concat(F.lit("several deliveries of "), F.col("day"))))
    return g.select("day", F.coalesce("exact", other).alias("delivery"))


def read_geolocation(spark: SparkSession, path: str, version: str) -> DataFrame:
    """fix_id, fix_time, view_angle, latitude, longitude of daily CSV deliveries under `path`, by position, whatever their headers."""
    raw = spark.read.schema(", ".join(f"_{i} string" for i in range(7))).option("header", True).option("enforceSchema", True).option("recursiveFileLookup", True).csv(path)
    raw = raw.withColumn("delivery", F.regexp_extract("_metadata.file_path", r"delivery=([^/]+)/", 1))
    rows = raw.join(delivered(raw.select("delivery"), version).select("delivery"), "delivery")
    fixes = rows.select(F.col("_4").cast("long").alias("fix_id"), F.col("_0").cast("timestamp_ntz").alias("fix_time"), F.col("_1").try_cast("double").alias("view_angle"), triple(F.col("_5")).alias("latitude"), triple(F.col("_6")).alias("longitude"))
    return positions(fixes, "latitude", "longitude")


def file_inventory(df: DataFrame, file: str, time: str, lat: str, lon: str) -> DataFrame:
    """Rows, time range and grid size per file."""
    return df.filter(F.col(file).isNotNull()).groupBy(file).agg(
        F.count("*").alias("n_rows"), F.min(time).alias("first_hour"), F.max(time).alias("last_hour"), F.count_distinct(lat).alias("n_latitudes"), F.count_distinct(lon).alias("n_longitudes")
    )


def with_metadata(df: DataFrame, entries: dict[str, str]) -> DataFrame:
    """df whose parquet files will carry the entries beside those it has: they travel in the schema that every footer holds."""
    first = df.schema[0]
    return df.withMetadata(first.name, {**(first.metadata or {}), **entries})


def metadata_of(df: DataFrame) -> dict[str, str]:
    """The entries of a table, as read from its footers."""
    return {k: v for f in df.schema for k, v in (f.metadata or {}).items()}


def gated(df: DataFrame, required: dict[str, str | None]) -> DataFrame:
    """df, if it carries the required entries (None: any value); else an error that names what is missing or differs."""
    have = metadata_of(df)
    wrong = {k: have.get(k) for k, v in required.items() if k not in have or (v is not None and have[k] != v)}
    if wrong:
        raise ValueError(f"table was not built as required: {wrong}")
    return df
