"""The limiter and windowed counts as streams."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


class Limiter(StatefulProcessor):
    """Keeps a key's window start and count. Rows of a micro-batch are taken in order of time."""

    def __init__(self, limit: int, window_ms: int):
        self.limit, self.window_ms = limit, window_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("window", "start bigint, used int")

    def handleInputRows(self, key, rows, timers):
        start, used = self.state.get() if self.state.exists() else (None, 0)
        frame = pd.concat(list(rows)).sort_values(["t_ms", "id"])
        out = []
        for t, i in zip(frame["t_ms"], frame["id"]):
            if start is None or t - start >= self.window_ms:
                start, used = int(t), 0
            used += 1
            out.append((key[0], int(i), used <= self.limit, used))
        self.state.update((start, used))
        yield pd.DataFrame(out, columns=["key", "id", "allowed", "used"])

    def close(self) -> None:
        pass


def limited(stream: DataFrame, limit: int, window_ms: int) -> DataFrame:
    """stream: key, t_ms, id. Needs the RocksDB state store."""
    return stream.groupBy("key").transformWithStateInPandas(statefulProcessor=Limiter(limit, window_ms), outputStructType="key bigint, id bigint, allowed boolean, used int", outputMode="Update", timeMode="None")


def windowed_counts(stream: DataFrame, late: str = "1 hour", width: str = "6 hours") -> DataFrame:
    """Events by type and tumbling window; windows close once the watermark has passed."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
