"""Streams over arriving event files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.session import shared_folder


def event_stream(spark: SparkSession, folder: str, file_glob: str) -> DataFrame:
    """Stream of the parquet files in a folder; event times get a zone, so that they can be watermarked."""
    schema = spark.read.option("pathGlobFilter", file_glob).parquet(folder).schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", file_glob).parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def first_seen(events: DataFrame, signature: Sequence[str], delay: str) -> DataFrame:
    """New signatures only; repeats within ``delay`` of event time are dropped, and state older than that is let go."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(list(signature))


def status_windows(events: DataFrame, status: Column, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Events per status and tumbling window."""
    counted = events.withWatermark("ts", delay).groupBy(F.window("ts", window).alias("w"), status.alias("status")).agg(F.count(F.lit(1)).alias("events"))
    return counted.select(F.col("w.start").alias("window_start"), "status", "events")


def drain(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over all that has arrived and give what it appended."""
    spark = stream.sparkSession
    out = shared_folder(spark, name)
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{out}-state").outputMode("append").trigger(availableNow=True).start(out)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def drain_updates(stream: DataFrame, name: str, keys: Sequence[str], value: str) -> DataFrame:
    """Run a stream in update mode and give each key's last value, open windows included.

    Every micro-batch appends its changed rows with its number; a batch that is
    repeated after a failure writes the same folder again.
    """
    spark = stream.sparkSession
    out = shared_folder(spark, name)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = stream.writeStream.option("checkpointLocation", f"{out}-state").outputMode("update").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    return spark.read.option("basePath", out).parquet(out).groupBy(*keys).agg(F.max_by(value, "batch").alias(value))
