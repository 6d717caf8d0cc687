"""Exact trailing-window rate limits on a stream of requests.

The state of a key is the times of its accepted requests in the trailing window, at most
``limit`` of them. A timer of the event-time watermark clears the state of keys that have
fallen silent. The batch form, serving.rate_limit, gives the same answers for rows in order.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: State stores that transformWithState needs.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class TrailingLimit(StatefulProcessor):
    """Rows (key, order, us) to (key, order, us, allowed): at most ``limit`` accepted in any ``window_us``."""

    def __init__(self, key: str, order: str, limit: int, window_us: int):
        self.key, self.order, self.limit, self.window_us = key, order, limit, window_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.times = handle.getListState("accepted", "us bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = deque(t for (t,) in self.times.get())
        batch = pd.concat(list(rows)).sort_values(["us", self.order], kind="stable")  # one key's requests of one trigger
        allowed = []
        for t in batch["us"].tolist():
            while held and held[0] <= t - self.window_us:
                held.popleft()
            allowed.append(len(held) < self.limit)
            if allowed[-1]:
                held.append(t)
        self.times.put([(t,) for t in held])
        for (old,) in [(x,) for x in self.handle.listTimers()]:
            self.handle.deleteTimer(old)
        if held:
            self.handle.registerTimer((held[-1] + self.window_us) // 1000 + 1)
        yield pd.DataFrame({self.key: key[0], self.order: batch[self.order].to_numpy(), "us": batch["us"].to_numpy(), "allowed": allowed})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.times.clear()
        yield pd.DataFrame({self.key: [], self.order: [], "us": [], "allowed": []}).astype({"us": "int64", "allowed": "bool"}).iloc[:0]

    def close(self) -> None:
        pass


def limited(requests: DataFrame, key: str, order: str, ts: str, limit: int = 60, seconds: float = 60, late: str = "0 seconds") -> DataFrame:
    """(key, order, us, allowed) of a stream of requests; those behind the watermark are left out by Spark."""
    kinds = dict(requests.dtypes)
    rows = requests.withWatermark(ts, late).select(key, order, ts, F.unix_micros(F.col(ts)).alias("us"))
    held = TrailingLimit(key, order, limit, int(seconds * 1_000_000))
    return rows.groupBy(key).transformWithStateInPandas(held, f"{key} {kinds[key]}, {order} {kinds[order]}, us long, allowed boolean", "Append", "EventTime")


def limit_files(spark, path: str, schema, key: str, order: str, ts: str, out: str, checkpoint: str, limit: int, seconds: float, files: int = 1):
    """Starts the limit over Parquet files arriving in ``path``, ``files`` a trigger, oldest first."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
    sink = limited(rows, key, order, ts, limit, seconds).writeStream.outputMode("append").format("parquet")
    return sink.option("checkpointLocation", checkpoint).option("path", out).trigger(availableNow=True).start()
