"""Order-dependent operators: token buckets, concurrency, hysteresis.

A token bucket's events are sorted inside their task and streamed past a state
of two numbers, so a key with very many events needs time but no memory.  The
others are running values over ranges of rows, whatever the keys' shares.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scan import last_known, running_sum


class Bucket:
    """Tokens of one key: refilled at ``rate`` a second up to ``burst``; an event needs one."""

    __slots__ = ("tokens", "at", "rate", "burst")

    def __init__(self, rate: float, burst: float, at: float):
        self.rate, self.burst, self.tokens, self.at = rate, burst, burst, at

    def take(self, at: float) -> bool:
        self.tokens = min(self.burst, self.tokens + max(0.0, at - self.at) * self.rate)
        self.at = at
        if self.tokens < 1.0:
            return False
        self.tokens -= 1.0
        return True


def token_bucket(events: DataFrame, rate: float, burst: float) -> DataFrame:
    """``events`` (key, event_id, at in seconds) with ``admitted``; equal times go by event_id."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, bucket = None, None
        for batch in batches:
            admitted = []
            for k, at in zip(batch["key"], batch["at"]):
                if bucket is None or k != key:
                    key, bucket = k, Bucket(rate, burst, at)
                admitted.append(bucket.take(at))
            yield batch.assign(admitted=admitted)

    ordered = events.select("key", "event_id", "at").repartition("key").sortWithinPartitions("key", "at", "event_id")
    return ordered.mapInPandas(run, "key long, event_id long, at double, admitted boolean")


def in_flight(events: DataFrame, parts: int | None = None) -> DataFrame:
    """``events`` (server, event_id, start, end) with ``running``: requests of the server that run when it starts.

    A request that ends at that very time has ended; of requests that start
    together the ones with smaller ids are running.  Starts and ends are one
    running sum in ranges, so a server may have any share of the requests.
    """
    ends = events.select("server", F.col("end").alias("t"), F.lit(0).alias("kind"), "event_id", F.lit(-1).alias("d"))
    starts = events.select("server", F.col("start").alias("t"), F.lit(1).alias("kind"), "event_id", F.lit(1).alias("d"))
    counted = running_sum(starts.union(ends), ["server"], ["t", "kind", "event_id"], "d", "running", parts)
    return counted.where("kind = 1").select("server", "event_id", F.col("running").cast("long"))


def hysteresis(samples: DataFrame, threshold: int, margin: float, parts: int | None = None) -> DataFrame:
    """``samples`` (probe, at, value) with ``ok`` and ``recovering``; larger values are worse.

    A value at the threshold or above fails and one below the recovery point
    is well, whatever came before; between them the last such value decides.
    So the state is the last decisive value, found in ranges of rows, and a
    probe may have any share of the samples.
    """
    recovery = int(threshold * (1.0 - margin))
    value = F.col("value")
    decisive = F.when(value >= threshold, F.lit(False)).when(value < recovery, F.lit(True))
    known = last_known(samples.withColumn("decisive_", decisive), ["probe"], ["at"], "decisive_", "ok", parts).drop("decisive_")
    return known.withColumn("ok", F.coalesce("ok", F.lit(True))).withColumn("recovering", ~F.col("ok") & (value < threshold))


def readiness(checks: DataFrame, key: str) -> DataFrame:
    """One row for each key: whether all its checks are well, how many, and the failed ones by name."""
    return checks.groupBy(key).agg(
        F.bool_and("ok").alias("ready"), F.count(F.lit(1)).alias("n_checks"),
        F.concat_ws(",", F.array_sort(F.collect_set(F.when(~F.col("ok"), F.col("name"))))).alias("failed"),
    )
