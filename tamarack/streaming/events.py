"""Structured Streaming over the events table: windowed totals with late data, and new arrivals once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.storage import tables_dir

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """Files of events as they arrive; event time as an instant, so that a watermark can be set."""
    return spark.readStream.schema(EVENTS).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_totals(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "30 minutes") -> DataFrame:
    """Events and their value by window and type; windows close once the watermark has passed them."""
    watermarked = events.withWatermark("ts", late) if events.isStreaming else events
    grouped = watermarked.groupBy(F.window("ts", width, slide) if slide else F.window("ts", width), "event_type")
    return grouped.agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).alias("value")).select("window", "event_type", "n", F.col("value").cast("double").alias("value"))


def sessions(events: DataFrame, gap: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Sessions of each user: runs of events with no gap longer than ``gap``."""
    watermarked = events.withWatermark("ts", late) if events.isStreaming else events
    return watermarked.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))


def without_repeats(events: DataFrame, late: str = "30 minutes") -> DataFrame:
    """Each event once, however often it is delivered within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])


def run_available(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Run a stream over all that is there now; what it has put out, read back from the shared folder.

    Complete output is kept in each batch's own folder and the last one counts; appended
    output is one table. Both are exactly-once: a batch that is run again replaces its folder.
    Appended windows and sessions are those that the watermark has closed, see ``with_end``.
    """
    spark = stream.sparkSession
    base = f"{tables_dir(spark)}/stream-{uuid.uuid4().hex}"
    last: list[int] = []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/{number:09d}")
        last.append(number)

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    if not last:
        return spark.createDataFrame([], stream.schema)
    paths = [f"{base}/out/{n:09d}" for n in ([max(last)] if mode == "complete" else sorted(set(last)))]
    return spark.read.schema(stream.schema).parquet(*paths)


def with_end(spark: SparkSession, path: str, after: str = "30 days") -> DataFrame:
    """The stream of ``path`` and one event far later, without a user or type, that moves the watermark past all windows.

    A watermark closes a window only when a later event comes: for a finite stream that is
    read in one batch this one stands for it. Its own window stays open, so it is never put out.
    """
    base = f"{tables_dir(spark)}/end-{uuid.uuid4().hex}"
    events = spark.read.schema(EVENTS).parquet(path)
    end = events.agg(F.max("ts").alias("ts")).where("ts is not null").select(F.lit(None).cast("bigint").alias("event_id"), (F.col("ts") + F.expr(f"interval {after}")).cast("timestamp_ntz").alias("ts"), F.lit(None).cast("bigint").alias("user_id"), F.lit(None).cast("string").alias("event_type"), F.lit(None).cast("double").alias("value"), F.lit(None).cast("string").alias("props"))
    end.write.parquet(base)
    return event_stream(spark, path).unionByName(event_stream(spark, base))
