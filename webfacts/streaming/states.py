"""State of each key over a stream: counts, averages, delays and heartbeats, which expire after a time without rows.

State lies in the state store, so a restart goes on where the last batch ended. A
batch's rows of a key come in parts and are dropped part by part; of a part, rows
go by time, and parts go as they come. ``prepare`` sets the store that such state
needs. Operators that go by the clock want a trigger of an interval, for there is
always another batch in which something may expire.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.folds import smoothed

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Outcomes that a key's list of recent ones holds.
RECENT = 20


def prepare(spark: SparkSession) -> None:
    """Keyed state of several variables, timers and time to live need the store on disk."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def _ms(span: str) -> int:
    return int(pd.Timedelta(span).total_seconds() * 1000)


class _Counts(StatefulProcessor):
    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("counts", "total long, successes long, last_us long", self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        total, successes, last = self.state.get() if self.state.exists() else (0, 0, -(2**63))
        for part in rows:
            total, successes, last = total + len(part), successes + int(part["ok"].sum()), max(last, int(part["us"].max()))
        self.state.update((total, successes, last))
        yield pd.DataFrame({"key": [key[0]], "total": [total], "successes": [successes], "last_us": [last]})


def reputation(stream: DataFrame, key: str, ok: Column, ttl: str = "24 hours") -> DataFrame:
    """(key, total, successes, last_at) for update mode, of a stream (key, ts): running counts, forgotten ``ttl`` after a key's last rows came."""
    rows = _known(stream, key).select(F.col(key).cast("string").alias("key"), F.unix_micros("ts").alias("us"), F.coalesce(ok, F.lit(False)).alias("ok"))
    out = rows.groupBy("key").transformWithStateInPandas(_Counts(_ms(ttl)), "key string, total long, successes long, last_us long", "update", "processingTime")
    return out.select(F.col("key").alias(key), "total", "successes", F.timestamp_micros("last_us").alias("last_at"))


class _Latency(StatefulProcessor):
    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("average", "average long, n long", self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        average, n = self.state.get() if self.state.exists() else (0, 0)
        for part in rows:
            for x in part.sort_values(["ts", "latency_ms"])["latency_ms"]:
                average, n = smoothed(average, int(x)), n + 1
        self.state.update((average, n))
        yield pd.DataFrame({"key": [key[0]], "avg_latency": [average], "n": [n]})


def latency(stream: DataFrame, key: str = "domain", ttl: str = "24 hours") -> DataFrame:
    """(key, avg_latency, n) for update mode, of a stream (key, ts, latency_ms): the first latency as it is, then whole parts of 0.7 old + 0.3 new.

    A key of which nothing came for ``ttl`` begins anew. Rows without a latency or
    a time are left out.
    """
    rows = _known(stream, key, "latency_ms").select(F.col(key).cast("string").alias("key"), "ts", F.col("latency_ms").cast("long").alias("latency_ms"))
    return rows.groupBy("key").transformWithStateInPandas(_Latency(_ms(ttl)), "key string, avg_latency long, n long", "update", "processingTime").withColumnRenamed("key", key)


class _Rate(StatefulProcessor):
    def __init__(self, ttl: int, default: float, most: float):
        self.ttl, self.default, self.most = ttl, default, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.delay = handle.getValueState("delay", "delay double", self.ttl)
        self.recent = handle.getListState("recent", "status int", self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        delay = self.delay.get()[0] if self.delay.exists() else self.default
        recent = [x[0] for x in self.recent.get()] if self.recent.exists() else []
        for part in rows:
            own = part.sort_values(["ts", "status"])["status"].tolist()
            for status in own:
                delay = min(delay * 2, self.most) if status in (429, 503) else max(delay * 0.9, self.default) if status == 200 else delay
            recent = [*recent, *own[-RECENT:]][-RECENT:]
        self.delay.update((delay,))
        self.recent.put([(int(x),) for x in recent])
        yield pd.DataFrame({"key": [key[0]], "delay": [delay], "refused": [sum(x in (429, 503) for x in recent) / len(recent)]})


def rate(stream: DataFrame, key: str = "domain", default: float = 1.0, most: float = 30.0, ttl: str = "24 hours") -> DataFrame:
    """(key, delay, refused) for update mode, of a stream (key, ts, status): 429 and 503 double a key's delay up to a bound, 200 lets it decay by a tenth.

    ``refused`` is their share of the key's last 20 rows. Both are forgotten when
    nothing came for ``ttl``. Rows without a status or a time are left out.
    """
    rows = _known(stream, key, "status").select(F.col(key).cast("string").alias("key"), "ts", F.col("status").cast("int").alias("status"))
    return rows.groupBy("key").transformWithStateInPandas(_Rate(_ms(ttl), default, most), "key string, delay double, refused double", "update", "processingTime").withColumnRenamed("key", key)


class _Beats(StatefulProcessor):
    def __init__(self, silence: int, event_time: bool):
        self.silence, self.event_time = silence, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.beats = handle.getValueState("beats", "beats long, due long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        beats, due = self.beats.get() if self.beats.exists() else (0, 0)
        newest = 0 if self.event_time else timerValues.getCurrentProcessingTimeInMs()
        for part in rows:
            beats += len(part)
            if self.event_time:
                newest = max(newest, int(part["ts"].max().timestamp() * 1000))
        after = max(due, newest + self.silence)
        if after > due:
            if due:
                self.handle.deleteTimer(due)
            self.handle.registerTimer(after)
        self.beats.update((beats, after))
        yield pd.DataFrame({"key": [key[0]], "beats": [beats], "stale": [False]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        beats = self.beats.get()[0]
        self.beats.clear()
        yield pd.DataFrame({"key": [key[0]], "beats": [beats], "stale": [True]})


def liveness(stream: DataFrame, key: str = "job_id", silence: str = "10 minutes", late: str | None = None) -> DataFrame:
    """(key, beats, stale) for update mode, of a stream of heartbeats (key, ts): a key is stale, and forgotten, ``silence`` after its last one.

    By the clock of the cluster, or, if ``late`` is given, by event time, where
    heartbeats later than that behind the newest one are dropped.
    """
    rows = _known(stream, key).select(F.col(key).cast("string").alias("key"), "ts")
    if late is not None:
        rows = rows.withWatermark("ts", late)
    return rows.groupBy("key").transformWithStateInPandas(_Beats(_ms(silence), late is not None), "key string, beats long, stale boolean", "update", "eventTime" if late is not None else "processingTime").withColumnRenamed("key", key)


def _known(stream: DataFrame, *columns: str) -> DataFrame:
    return stream.where(F.col("ts").isNotNull()).where(" and ".join(f"`{c}` is not null" for c in columns))
