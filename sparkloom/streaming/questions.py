"""Structured Streaming forms of the batch operators."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators.graph import drop, shared_dir


def windowed_counts(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Counts and sums by window and type; rows later than the watermark are dropped by Spark."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def first_seen(events: DataFrame, key: str, late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def sessions(events: DataFrame, key: str, gap: str, late: str = "1 hour") -> DataFrame:
    """key, start, finish, n, total of each session: rows of one key no further apart than the gap. A session comes out once the
    watermark has passed its end; rows later than the watermark are dropped by Spark, ``replay.split_late`` keeps them."""
    held = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return held.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("finish"), "n", "total")


def closing(events: DataFrame, ts: str, after: str) -> DataFrame:
    """One row like those of events, null but for a time so much after the last: it moves the watermark, so that a stream that
    ends gives what it still holds. Its own window or session stays open and does not come out."""
    last = events.agg((F.max(ts) + F.expr(f"interval {after}")).alias(ts))
    return last.select(*(F.col(ts) if f.name == ts else F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema))


def run_once(spark: SparkSession, stream: DataFrame, keys: list[str]) -> DataFrame:
    """Everything that a stream has now, as a table: each batch adds the rows that it changed to files in the shared
    folder, and of the rows of one key the last batch's stays."""
    path = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    atexit.register(drop, spark, path)

    def add(rows: DataFrame, batch: int) -> None:
        rows.withColumn("batch", F.lit(batch)).write.mode("append").parquet(f"{path}/rows")

    stream.writeStream.outputMode("update").option("checkpointLocation", f"{path}/state").foreachBatch(add).trigger(availableNow=True).start().awaitTermination()
    values = [c for c in stream.columns if c not in keys]
    found = spark.read.parquet(f"{path}/rows").groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("x"))
    return found.select(*keys, "x.*").select(*stream.columns)
