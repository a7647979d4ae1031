"""Structured Streaming forms of the batch aggregations: tumbling means, deduplication, running missingness.

`replayed` drives a streaming query over a parquet folder to its end and returns what it wrote, for backfills and tests; the
same builders take any streaming source.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skygrain.functions.exprs import finite
from skygrain.sources.scratch import new_path


def source(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A streaming scan of a table that is there; its schema is read first."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    # A pattern finds a table of one file as well as one of a folder; a plain path must be a folder.
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")


def windowed_mean(stream: DataFrame, time: str, value: str, keys: list[str], width: str, delay: str) -> DataFrame:
    """Mean and count of the finite values per key and tumbling window; rows later than `delay` are the caller's to fear.

    Windows without a finite value are left out, in the result and not before: any row's time moves the watermark.
    """
    s = stream.filter(F.col(time).isNotNull()).withColumns({"_at": F.col(time).cast("timestamp"), "_v": F.when(finite(F.col(value)), F.col(value))})
    g = s.withWatermark("_at", delay).groupBy(F.window("_at", width), *keys).agg(F.avg("_v").alias("mean"), F.count("_v").alias("n")).filter("n > 0")
    return g.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), *keys, "mean", "n")


def deduplicated(stream: DataFrame, time: str, keys: list[str], delay: str) -> DataFrame:
    """One row per key; state is dropped once the watermark has passed."""
    s = stream.filter(F.col(time).isNotNull()).withColumn("_at", F.col(time).cast("timestamp"))
    return s.withWatermark("_at", delay).dropDuplicatesWithinWatermark(keys).drop("_at")


def running_missingness(stream: DataFrame, columns: list[str]) -> DataFrame:
    """Rows and missing values per column so far; the same whatever the batches."""
    parts = [F.struct(F.lit(c).alias("variable"), finite(F.col(c)).alias("ok")) for c in columns]
    flat = stream.select(F.explode(F.array(*parts)).alias("p")).select("p.*")
    return flat.groupBy("variable").agg(F.count("*").alias("n_rows"), F.count_if(~F.col("ok")).alias("n_missing"))


def replayed(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All that a streaming query writes over the data that is there.

    Appended rows go to a parquet sink. A complete result is small and replaces itself with each batch in one folder.
    """
    spark = stream.sparkSession
    base = new_path(spark, "stream")
    writer = stream.writeStream.option("checkpointLocation", f"{base}/state").outputMode(mode).trigger(availableNow=True)
    if mode == "append":
        q = writer.format("parquet").start(f"{base}/out")
    else:
        replace: Callable[[DataFrame, int], None] = lambda df, _: df.write.mode("overwrite").parquet(f"{base}/out")
        q = writer.foreachBatch(replace).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def flushed(df: DataFrame, time: str, build: Callable[[DataFrame], DataFrame], last: str = "9000-01-01 00:00:00") -> DataFrame:
    """All that an append-mode query over df writes, its open windows closed by a row at `last` after all others.

    The rows are staged as the stream's input; the closing row, null but for its time, follows when they are through, so state
    holds what the watermark still allows and every finished window is written once.
    """
    spark = df.sparkSession
    base = new_path(spark, "stream")
    df.write.parquet(f"{base}/in")
    out = build(spark.readStream.schema(df.schema).parquet(f"{base}/in"))
    q = out.writeStream.option("checkpointLocation", f"{base}/state").outputMode("append").format("parquet").start(f"{base}/out")
    try:
        q.processAllAvailable()
        end = spark.range(1).select(*[(F.lit(last) if f.name == time else F.lit(None)).cast(f.dataType).alias(f.name) for f in df.schema])
        end.write.mode("append").parquet(f"{base}/in")
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.read.schema(out.schema).parquet(f"{base}/out")
