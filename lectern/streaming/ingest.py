"""Structured Streaming forms: windowed counts over an event stream, and incremental intake of new files."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.session import checkpoint_dir


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums of each type of event in tumbling windows; the watermark bounds the state. For streams and tables."""
    # A watermark needs an instant, which a timestamp without a zone becomes in the session's zone.
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if events.isStreaming else timed
    grouped = timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "total")


def run_available(stream: DataFrame, into: Callable[[DataFrame, int], None], mode: str = "update") -> None:
    """Handles everything that is there now and stops. A batch is handled again if it was cut short, so ``into`` must give
    the same result when it gets a batch number twice."""
    spark = stream.sparkSession
    place = f"{checkpoint_dir(spark)}/streams/{uuid4()}"
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", place).foreachBatch(into).trigger(availableNow=True).start()
    query.awaitTermination()


def windows_of_files(spark: SparkSession, folder: str, width: str = "1 hour") -> DataFrame:
    """``event_windows`` of the event files of a folder, read as a stream until all are handled.

    Batches write to a table of their own number; the last version of a window counts.
    """
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    # A stream's source is a folder; the table may be a file in it.
    pattern = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("maxFilesPerTrigger", 64)
    stream = pattern.parquet(f"{folder}/events.parquet*")
    out = f"{checkpoint_dir(spark)}/windows/{uuid4()}"
    run_available(event_windows(stream, width), lambda batch, number: batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/{number}"))
    versions = spark.read.option("recursiveFileLookup", True).parquet(out)
    last = F.max_by(F.struct("n", "total"), "batch").alias("v")
    return versions.groupBy("window_start", "event_type").agg(last).select("window_start", "event_type", "v.n", "v.total")
