"""Streaming forms of the limits: keyed state with timers, and windowed rates with a watermark.

A processor's state is one row a key in the state store.  The events of a
micro-batch come in pieces in no order; only their times and numbers are
gathered and sorted, and the trigger bounds how many these are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.limits import Bucket
from ..operators.metrics import route

#: The state store that keyed state with timers needs.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def use_state_store(spark: SparkSession) -> None:
    spark.conf.set(*STORE)


def _gathered(rows: Iterator[pd.DataFrame], columns: list[str]) -> dict[str, np.ndarray]:
    """The columns of all pieces, sorted by the first, then by the second."""
    pieces = [[batch[c].to_numpy() for c in columns] for batch in rows]
    whole = [np.concatenate(x) for x in zip(*pieces)]
    order = np.lexsort(whole[1::-1]) if len(whole) > 1 else np.argsort(whole[0], kind="stable")
    return {c: x[order] for c, x in zip(columns, whole)}


def _milliseconds(at: float) -> int:
    """Whole milliseconds of a time in seconds, which is exact to the microsecond."""
    return round(at * 1_000_000) // 1000


class TokenBuckets(StatefulProcessor):
    """A bucket for each key: its tokens and the time of its last event.

    With ``idle`` (milliseconds of event time) a key that has no event for
    longer loses its state: by a timer when the watermark passes, or when the
    next event shows it.  It then starts with a full bucket.
    """

    def __init__(self, rate: float, burst: float, idle: int | None = None):
        self.rate, self.burst, self.idle = rate, burst, idle

    def init(self, handle):
        self.handle = handle
        self.state = handle.getValueState("bucket", "tokens double, at double")

    def _expiry(self, at: float) -> int:
        return _milliseconds(at) + self.idle

    def _rows(self, key: tuple, events: list[tuple]) -> pd.DataFrame:
        ids, ats, admitted, expired = zip(*events)
        return pd.DataFrame({
            "key": [key[0]] * len(ids), "event_id": pd.array(ids, "Int64"), "at": pd.array(ats, "Float64"),
            "admitted": pd.array(admitted, "boolean"), "expired_ms": pd.array(expired, "Int64"),
        })

    def handleInputRows(self, key, rows, timerValues):
        events, out = _gathered(rows, ["at", "event_id"]), []
        known = self.state.exists()
        if known:
            tokens, at = self.state.get()
            bucket = Bucket(self.rate, self.burst, at)
            bucket.tokens = tokens
            if self.idle is not None:
                self.handle.deleteTimer(self._expiry(at))
        else:
            bucket = Bucket(self.rate, self.burst, float(events["at"][0]))
        for at, event_id in zip(events["at"].tolist(), events["event_id"].tolist()):
            if self.idle is not None and _milliseconds(at) > self._expiry(bucket.at):
                out.append((None, None, None, self._expiry(bucket.at)))
                bucket = Bucket(self.rate, self.burst, at)
            out.append((event_id, at, bucket.take(at), None))
        self.state.update((bucket.tokens, bucket.at))
        if self.idle is not None:
            self.handle.registerTimer(self._expiry(bucket.at))
        yield self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.state.clear()
        yield self._rows(key, [(None, None, None, expiredTimerInfo.getExpiryTimeInMs())])

    def close(self):
        pass


def token_bucket_stream(events: DataFrame, rate: float, burst: float, idle: str | None = None, late: str = "0 seconds") -> DataFrame:
    """``events`` (key, event_id, at in seconds) with ``admitted``, and ``expired_ms``, null for an event.

    With ``idle``, such as ``5 minutes``, a key that stays idle for longer in
    event time is forgotten, and a row without an event says when
    (``expired_ms``); events later than ``late`` behind the newest one are dropped.
    """
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000) if idle else None
    rows = events.select("key", "event_id", "at")
    if idle:
        rows = rows.withColumn("time_", F.timestamp_micros(F.round(F.col("at") * 1_000_000).cast("long"))).withWatermark("time_", late)
    return rows.groupBy("key").transformWithStateInPandas(
        TokenBuckets(rate, burst, idle_ms), "key long, event_id long, at double, admitted boolean, expired_ms long", "append",
        "eventtime" if idle else "none",
    )


class Readiness(StatefulProcessor):
    """For each probe whether it is well; a value between recovery point and threshold changes nothing."""

    def __init__(self, threshold: int, margin: float):
        self.threshold, self.recovery = threshold, int(threshold * (1.0 - margin))

    def init(self, handle):
        self.state = handle.getValueState("ok", "ok boolean")

    def handleInputRows(self, key, rows, timerValues):
        samples = _gathered(rows, ["at", "value"])
        value = samples["value"]
        decisive = np.where(value >= self.threshold, 0, np.where(value < self.recovery, 1, -1))
        last = np.maximum.accumulate(np.where(decisive >= 0, np.arange(len(value)), -1))
        before = self.state.get()[0] if self.state.exists() else True
        ok = np.where(last >= 0, decisive[last] == 1, before)
        self.state.update((bool(ok[-1]),))
        yield pd.DataFrame({"probe": key[0], "at": samples["at"], "value": value, "ok": ok, "recovering": ~ok & (value < self.threshold)})

    def close(self):
        pass


def hysteresis_stream(samples: DataFrame, threshold: int, margin: float) -> DataFrame:
    """``samples`` (probe, at, value) with ``ok`` and ``recovering``; a micro-batch is ordered by ``at``, batches by arrival."""
    return samples.select("probe", "at", "value").groupBy("probe").transformWithStateInPandas(
        Readiness(threshold, margin), "probe long, at long, value long, ok boolean, recovering boolean", "append", "none"
    )


class ScanClock(StatefulProcessor):
    """For each node the time of its last scan; the state of a node without writes goes by its time to live."""

    def __init__(self, interval: int, keep_ms: int | None):
        self.interval, self.keep_ms = interval, keep_ms

    def init(self, handle):
        self.state = handle.getValueState("last", "second bigint", *([self.keep_ms] if self.keep_ms else []))

    def handleInputRows(self, key, rows, timerValues):
        seconds = np.unique(_gathered(rows, ["second"])["second"])
        last = self.state.get()[0] if self.state.exists() else None
        at, picked = 0 if last is None else int(np.searchsorted(seconds, last + self.interval)), []
        while at < len(seconds):
            picked.append(int(seconds[at]))
            at = int(np.searchsorted(seconds, picked[-1] + self.interval))
        if picked:
            self.state.update((picked[-1],))
            yield pd.DataFrame({"node": key[0], "second": picked})

    def close(self):
        pass


def eviction_scans_stream(writes: DataFrame, interval: int = 60, keep: str | None = None) -> DataFrame:
    """``writes`` (node, second) that start a scan: the first of a node, then any ``interval`` seconds or more after the last.

    With ``keep``, which should be longer than the interval, the state of a
    node that has not scanned for so long in processing time is dropped; such
    a query wakes up for ever, so it does not end when its input does.
    """
    keep_ms = int(pd.Timedelta(keep).total_seconds() * 1000) if keep else None
    return writes.select("node", "second").where("node IS NOT NULL AND second IS NOT NULL").groupBy("node").transformWithStateInPandas(
        ScanClock(interval, keep_ms), "node long, second long", "append", "processingtime" if keep else "none"
    )


def rate_stream(log: DataFrame, minutes: int = 5, late: str = "10 minutes") -> DataFrame:
    """Requests and server errors of each route by tumbling window; later events than the watermark are dropped."""
    timed = log.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", f"{minutes} minutes"), route(F.col("method"), F.col("path")).alias("route")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") >= "500").alias("errors"),
    ).select(F.unix_seconds("window.start").alias("window_start"), "route", "n", "errors")
