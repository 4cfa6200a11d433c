"""Fetches at a limited rate per host, on a stream with one keyed state a host and as a batch window."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

#: Seconds between two requests to one host; seconds after which a quiet host's state goes.
GAP, IDLE = 1.5, 3600.0
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _micros(seconds: float) -> int:
    return round(seconds * 1_000_000)


class Pace(StatefulProcessor):
    """Holds when a host may be asked next. A batch's requests of a host are taken in the order of arrival and id; each starts
    when it arrives or when the host is free, whichever is later. A timer clears the state of a host that has been free for
    ``idle``; by then every row that the watermark lets in arrives after that time, so no start changes."""

    def __init__(self, gap: int, idle: int) -> None:
        self.gap, self.idle = gap, idle

    def init(self, handle) -> None:
        self.handle, self.free = handle, handle.getValueState("free", "free long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(["at", "id"], kind="stable")
        steps = np.arange(len(frame), dtype=np.int64) * self.gap
        early = frame["at"].to_numpy(np.int64) - steps
        if self.free.exists():
            early[0] = max(early[0], self.free.get()[0])
        frame["start"] = np.maximum.accumulate(early) + steps
        free = int(frame["start"].iloc[-1]) + self.gap
        self.free.update((free,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer((free + self.idle) // 1000 + 1)
        yield frame[["host", "id", "at", "start"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.free.clear()
        yield pd.DataFrame({"host": pd.Series([], dtype=str), "id": pd.Series([], dtype="int64"), "at": pd.Series([], dtype="int64"), "start": pd.Series([], dtype="int64")})

    def close(self) -> None:
        pass


def starts(requests: DataFrame, gap: float = GAP, idle: float = IDLE, late: str = "0 seconds") -> DataFrame:
    """host, id, at, start of a stream of requests (host, id long, at timestamp). Requests older than the watermark are dropped by
    Spark; ``replay.split_late`` keeps them. A null host is a host of its own. A host's requests of one batch are held
    together: the source's options bound a batch. Needs the RocksDB state store (``PROVIDER``)."""
    plain = requests.withWatermark("at", late).select(F.col("host"), F.col("id"), F.col("at").alias("time"), F.unix_micros("at").alias("at"))
    held = plain.groupBy("host").transformWithStateInPandas(Pace(_micros(gap), _micros(idle)), "host string, id long, at long, start long", "Append", "EventTime")
    return held.select("host", "id", F.timestamp_micros("at").alias("at"), F.timestamp_micros("start").alias("start"))


def starts_batch(requests: DataFrame, gap: float = GAP) -> DataFrame:
    """The same of a whole table: the i-th request of a host starts i gaps after the latest of what came before it, as far as each
    was i gaps away. One host's requests go through one task, as they go through one host."""
    order = Window.partitionBy("host").orderBy("at", "id")
    i: Column = (F.row_number().over(order) - 1).cast("long") * F.lit(_micros(gap))
    numbered = requests.withColumn("i__", i)
    start = F.max(F.unix_micros("at") - F.col("i__")).over(order.rowsBetween(Window.unboundedPreceding, 0)) + F.col("i__")
    return numbered.withColumn("start", F.timestamp_micros(start)).select("host", "id", "at", "start")
