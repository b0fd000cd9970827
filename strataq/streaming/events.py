"""Event-time streaming over an events folder, with batch twins.

A stream reads Parquet files as they come; aggregates have a watermark, so state is bounded, and end up in a table in the
shared folder. drain() runs what is there to completion (trigger availableNow) and returns the sink as a DataFrame.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataq.session import shared_dir

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
WATERMARK = "1 hour"


def source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream; one file a trigger is read at least."""
    return spark.readStream.schema(SCHEMA).option("pathGlobFilter", "events.parquet*").parquet(sf_dir)


def tumbling(events: DataFrame, width: str = "1 hour") -> DataFrame:
    w = F.window("ts", width)
    return events.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "1 hour", step: str = "15 minutes") -> DataFrame:
    w = F.window("ts", width, step)
    return events.groupBy(w.alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "n")


def user_sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    w = F.session_window("ts", gap)
    return events.groupBy(w.alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def deduplicated(events: DataFrame) -> DataFrame:
    """First events of each id; keys are forgotten once the watermark has passed."""
    return events.dropDuplicatesWithinWatermark(["event_id"]).select("event_id", "event_type")


def drain(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Runs a stream over all that is there and returns its sink. Complete results are replaced a trigger at a time."""
    spark = stream.sparkSession
    name = uuid.uuid4().hex
    where = f"{shared_dir(spark).rstrip('/')}/stream-{name}"

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{where}/out")

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    return spark.read.schema(stream.schema).parquet(f"{where}/out")
