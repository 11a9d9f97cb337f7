"""The same accounting on streams."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import usage

LOG = "id long, ts timestamp, owner string, cost double"


def daily_spend(log: DataFrame, late: str = "1 day") -> DataFrame:
    """day, owner, spent of a stream, each day when its window closes behind the watermark."""
    good = log.filter("cost > 0").withWatermark("ts", late)
    return good.groupBy(F.window("ts", "1 day"), "owner").agg(F.sum("cost").alias("spent")).select(F.col("window.start").cast("date").alias("day"), "owner", "spent")


class Limiter(StatefulProcessor):
    """A client's admitted requests of the last `window` seconds. What is kept for a client is those times, at most `most`
    of them; once the watermark is past the last one's window, a timer lets go of them."""

    def __init__(self, most: int, window: float):
        self.most, self.window = most, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.held = handle, handle.getListState("held", "at double")

    def keep(self, times: list[float]) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if times:
            self.held.put([(t,) for t in times])
            self.handle.registerTimer(int((times[-1] + self.window) * 1000) + 1)
        else:
            self.held.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = deque(t for (t,) in self.held.get())
        batch = pd.concat([r[["id", "at"]] for r in rows]).sort_values(["at", "id"], kind="stable")
        out = np.zeros(len(batch), bool)
        for i, at in enumerate(batch["at"].tolist()):
            while held and at - held[0] >= self.window:
                held.popleft()
            out[i] = self.most <= 0 or len(held) < self.most
            if out[i] and self.most > 0:
                held.append(at)
        self.keep(list(held))
        yield pd.DataFrame({"id": batch["id"].to_numpy(), "admitted": out})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        past = timerValues.getCurrentWatermarkInMs() / 1000 - self.window
        self.keep([t for (t,) in self.held.get() if t > past])
        yield pd.DataFrame({"id": np.zeros(0, np.int64), "admitted": np.zeros(0, bool)})

    def close(self) -> None:
        pass


def rate_limit(log: DataFrame, most: int = 20, window: float = 60.0, late: str = "1 minute") -> DataFrame:
    """id, admitted of a stream, by client (the owner): at most `most` admitted requests within `window` seconds; refused
    ones don't count. Requests behind the watermark, `late` after the latest one seen, are dropped. Needs the session's
    state store to be RocksDB (see `rocks`)."""
    timed = log.withWatermark("ts", late).select("id", "owner", "ts", (F.unix_micros("ts") / 1e6).alias("at"))
    return timed.groupBy("owner").transformWithStateInPandas(Limiter(most, window), "id long, admitted boolean", "append", "EventTime")


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB, which spills to disk and writes what has changed."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def log_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Good lines of JSON logs that arrive in a folder."""
    return usage.parse_log_lines(spark.readStream.text(folder))[0]


def replayed(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """All that a stream gives for what is there now, as a table in `checkpoint`."""
    out = f"{checkpoint}/{name}-out"
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", f"{checkpoint}/{name}-state").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)
