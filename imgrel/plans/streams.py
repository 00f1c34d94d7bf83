"""Queries that read a table as a stream of files, with keyed state; their SQL is that of the batch forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.views import duck
from ..streaming import feeds, limits
from .origin import C7
from .service import H1, R1

def _seconds():
    return F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000


def _log(spark, sf):
    limits.use_state_store(spark)
    return feeds.stream_view(spark, sf, "log", "events")


def r1_stream(spark, sf):
    """The token bucket with its state in the store."""
    events = _log(spark, sf).select(F.col("user_id").alias("key"), "event_id", _seconds().alias("at"))
    found = feeds.drained(limits.token_bucket_stream(events, rate=0.0001, burst=2.0))
    return found.groupBy("key").agg(F.count_if("admitted").alias("admitted"), F.count(F.lit(1)).alias("n"))


def r2_idle(spark, sf):
    """Keys that are forgotten after a day without a request: when another one shows it, or by a timer at the end."""
    events = _log(spark, sf).select(F.col("user_id").alias("key"), "event_id", _seconds().alias("at"))
    found = feeds.drained(limits.token_bucket_stream(events, rate=0.0001, burst=2.0, idle="1 day"))
    return found.where("expired_ms IS NOT NULL").select("key", "expired_ms")


R2 = duck("log") + """, e AS (SELECT user_id AS key, epoch_us(ts) // 1000 AS ms FROM log),
n AS (SELECT key, ms, lead(ms) OVER (PARTITION BY key ORDER BY ms) AS following, max(ms) OVER () AS newest FROM e)
SELECT key, ms + 86400000 AS expired_ms FROM n WHERE coalesce(following, newest) > ms + 86400000"""


def h1_stream(spark, sf):
    """Hysteresis with the last state of each probe in the store."""
    samples = _log(spark, sf).select(
        (F.col("user_id") % 5).alias("probe"), F.col("event_id").alias("at"), F.floor(F.col("latency_s") * 40).cast("long").alias("value")
    )
    return feeds.drained(limits.hysteresis_stream(samples, threshold=900, margin=0.1))


def c7_stream(spark, sf):
    """Eviction scans with the last one of each node in the store."""
    writes = _log(spark, sf).select((F.col("user_id") % 8).alias("node"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("second"))
    return feeds.drained(limits.eviction_scans_stream(writes, interval=86400))


QUERIES = {"r1_stream": (r1_stream, R1), "r2_idle": (r2_idle, R2), "h1_stream": (h1_stream, H1), "c7_stream": (c7_stream, C7)}
