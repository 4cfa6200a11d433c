"""Sinks that a repeated batch does not double, and streams fed part by part."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.graph import drop, shared_dir


def once_a_batch(path: str, make: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: what make gives of a batch's rows goes to a folder of that batch, which a repeated batch replaces."""

    def put(rows: DataFrame, batch: int) -> None:
        make(rows).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return put


def split_late(path: str, late: str, ts: str = "ts") -> Callable[[DataFrame, int], None]:
    """For foreachBatch: rows older than the watermark (the latest time of the batches before, less ``late``) go to path/late, the
    others to path/kept. The latest time of each batch is kept beside them, so a repeated batch splits as it did the first
    time. Rows without a time are late."""

    def put(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        marks = spark.read.schema("latest timestamp, batch int").parquet(f"{path}/marks") if batch else None
        seen = marks.where(F.col("batch") < batch).agg((F.max("latest") - F.expr(f"interval {late}")).alias("w")).first()["w"] if batch else None
        old = F.col(ts).isNull() if seen is None else F.coalesce(F.col(ts) < F.lit(seen), F.lit(True))
        rows.persist()
        rows.where(old).write.mode("overwrite").parquet(f"{path}/late/batch={batch}")
        rows.where(~old).write.mode("overwrite").parquet(f"{path}/kept/batch={batch}")
        rows.agg(F.max(F.col(ts).cast("timestamp")).alias("latest")).write.mode("overwrite").parquet(f"{path}/marks/batch={batch}")
        rows.unpersist()

    return put


def replay(parts: list[DataFrame], build: Callable[[DataFrame], DataFrame], sink: Callable[[str], Callable[[DataFrame, int], None]], options: dict[str, str] | None = None) -> str:
    """Lands each part as files and lets a stream take what has landed, one run a part; each run goes on from the checkpoint
    of the one before. build makes the stream of the source, sink the batch function of a folder, which is returned."""
    spark = parts[0].sparkSession
    folder = f"{shared_dir(spark)}/replay-{uuid.uuid4().hex}"
    atexit.register(drop, spark, folder)
    for part in parts:
        part.write.mode("append").parquet(f"{folder}/in")
        source = spark.readStream.schema(parts[0].schema).options(**(options or {})).parquet(f"{folder}/in")
        writer = build(source).writeStream.outputMode("append").option("checkpointLocation", f"{folder}/state")
        writer.foreachBatch(sink(f"{folder}/out")).trigger(availableNow=True).start().awaitTermination()
    return f"{folder}/out"
