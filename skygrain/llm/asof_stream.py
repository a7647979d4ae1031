"""Nearest record in time by a stateful streaming join.

Both tables are replayed in event-time order as streams. The join buffers both sides in state per (entity, cell of time),
where a cell is CELLS_OF tolerances long and right records near its border also enter the neighbouring cell, so an entity
that holds a third of all rows is spread over the state partitions. The watermark follows both streams: right records that
no left record can still reach are evicted, and a left row leaves, with the nearest of its candidates, once the watermark
has passed its tolerance horizon.

The replay is cut by time into slices of about ROWS_PER_CORE rows per core of the cluster, so a larger cluster takes a larger
table in as many micro-batches. A slice is one micro-batch, and slices come in order, so state holds a slice and a
tolerance, and no row is late whatever the order of the tables' files. Borders come from a running total over the counts of
spans of time, as a table that rows are joined with. Rows go to the stream's folder in `spark.checkpoint.dir`, where state
and results are kept as well; a lost executor is recovered from there.

Defined results: rows with null entity or time, and right rows that `right` doesn't hold at all, match nothing; entities are
equal as given (normalise before); of equally near right rows the smaller key wins; repeated rows are rows of their own, and
a left key that occurs twice with equal time gives one row; left rows without a right row within tolerance are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skygrain.functions.exprs import micros
from skygrain.functions.prefix import running_total
from skygrain.sources.scratch import new_path, written

CELLS_OF, SPAN_CELLS, ROWS_PER_CORE = 16, 64, 100_000
LAST = 253402300000000000  # a time after all others: moves the watermark past the last row


def _moved(spark, source: str, target: str) -> None:
    """Renames a finished slice into the stream's folder; a file of a slice appears there whole or not at all."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(source)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(jvm.org.apache.hadoop.fs.Path(target).getParent())
    if fs.exists(at) and not fs.rename(at, jvm.org.apache.hadoop.fs.Path(target)):
        raise RuntimeError(f"can't move {source}")


def events(left: DataFrame, right: DataFrame, tolerance_us: int) -> DataFrame:
    """(entity, cell, t, key, side) of both tables; left and right have columns entity, t, key (microseconds, long)."""
    cell = CELLS_OF * tolerance_us
    at = lambda t: F.floor(t / cell).cast("long")
    known = "entity is not null and t is not null and key is not null"
    one = left.filter(known).select("entity", at(F.col("t")).alias("cell"), "t", "key", F.lit(0).alias("side"))
    cells = F.array_distinct(F.array(at(F.col("t") - tolerance_us), at(F.col("t") + tolerance_us)))
    two = right.filter(known).select("entity", F.explode(cells).alias("cell"), "t", "key", F.lit(1).alias("side"))
    return one.unionByName(two)


def _staged(every: DataFrame, span: int, path: str) -> list[int]:
    """Writes the rows by slice of time; the numbers of the slices that hold any, in order. A slice is whole spans."""
    cores = every.sparkSession.sparkContext.defaultParallelism
    at = F.floor(F.col("t") / span).cast("long")
    counts = written(every.groupBy(at.alias("span")).agg(F.count("*").alias("c")), "span-counts")
    before = running_total(counts, [], F.floor(F.col("span") / 1024), ["span"], F.col("c"), "before")
    slices = written(before.select("span", F.floor(F.col("before") / (ROWS_PER_CORE * cores)).alias("slice")), "slices")
    out = every.withColumn("span", at).join(slices, "span").drop("span")
    # Within a slice rows are spread by key over as many files as there are cores to read them.
    out.repartition("slice", F.pmod(F.xxhash64("entity", "cell"), F.lit(cores))).write.partitionBy("slice", "side").parquet(path)
    return [r["slice"] for r in slices.select("slice").distinct().orderBy("slice").collect()]  # one row per micro-batch


def nearest(left: DataFrame, right: DataFrame, tolerance_us: int) -> DataFrame:
    """(key, right_key, gap_us): for each left row the nearest right row of its entity within the tolerance."""
    spark = left.sparkSession
    base = new_path(spark, "asof")
    entity = left.schema["entity"].dataType.simpleString()
    sentinel = spark.range(2).select(F.lit("\u0000last").cast(entity).alias("entity"), F.lit(0).cast("long").alias("cell"), F.lit(LAST).alias("t"), F.lit(-1).cast("long").alias("key"), F.col("id").cast("int").alias("side"))
    slices = _staged(events(left, right, tolerance_us), SPAN_CELLS * CELLS_OF * tolerance_us, f"{base}/staged")
    slices.append(slices[-1] + 1 if slices else 0)
    sentinel.write.partitionBy("side").parquet(f"{base}/staged/slice={slices[-1]}")

    def stream(side: int) -> DataFrame:
        rows = spark.readStream.schema(f"entity {entity}, cell long, t long, key long").parquet(f"{base}/in/side={side}/*")
        rows = rows.withColumn("at", F.timestamp_micros("t"))
        return rows.withWatermark("at", "0 seconds").select(*[F.col(c).alias(f"{'lr'[side]}_{c}") for c in ("entity", "cell", "t", "key", "at")])

    for side in (0, 1):
        _made(spark, f"{base}/in/side={side}")
    reach = f"interval {tolerance_us} microseconds"
    joined = stream(0).join(stream(1), F.expr(f"l_entity = r_entity and l_cell = r_cell and r_at >= l_at - {reach} and r_at <= l_at + {reach}"))
    gap = F.abs(F.col("l_t") - F.col("r_t"))
    best = joined.groupBy("l_at", "l_key").agg(F.min(F.struct(gap.alias("gap"), F.col("r_key").alias("k"))).alias("b"))
    query = best.select(F.col("l_key").alias("key"), F.col("b.k").alias("right_key"), F.col("b.gap").alias("gap_us")).writeStream.format("parquet").option("checkpointLocation", f"{base}/state").outputMode("append").start(f"{base}/out")
    try:
        for k in slices:
            for side in (0, 1):
                _moved(spark, f"{base}/staged/slice={k}/side={side}", f"{base}/in/side={side}/slice={k}")
            query.processAllAvailable()
    finally:
        query.stop()
    return spark.read.schema("key long, right_key long, gap_us long").parquet(f"{base}/out")


def _made(spark, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(at)


def event_rows(df: DataFrame, entity, time, key) -> DataFrame:
    """(entity, t, key) for `nearest`."""
    return df.select(entity.alias("entity"), micros(time).alias("t"), key.cast("long").alias("key"))
