"""The streaming twins give what the batch forms give."""

import time

import pytest
from pyspark.sql import functions as F

from imgrel.operators import limits, metrics, origin
from imgrel.sources.views import view
from imgrel.streaming import limits as streams
from imgrel.streaming.feeds import drained
from imgrel.streaming.limits import rate_stream, token_bucket_stream


@pytest.fixture(autouse=True)
def _store(spark):
    streams.use_state_store(spark)


def run(spark, df, name, mode):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    try:
        assert query.awaitTermination(90)
    finally:
        query.stop()
    return spark.table(name)


def source(spark, sf_dir, tmp_path, columns):
    path = str(tmp_path / "in")
    view(spark, sf_dir, "log").select(*columns).coalesce(1).write.parquet(path)
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path), spark.read.parquet(path)


def test_token_bucket(spark, sf_dir, tmp_path):
    at = (F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("at")
    stream, batch = source(spark, sf_dir, tmp_path, [F.col("user_id").alias("key"), "event_id", at])
    found = {(r.key, r.event_id, r.admitted) for r in run(spark, token_bucket_stream(stream, 0.0001, 2.0), "buckets", "append").collect()}
    assert found == {(r.key, r.event_id, r.admitted) for r in limits.token_bucket(batch, 0.0001, 2.0).collect()}
    assert {a for *_, a in found} == {True, False}


def test_rates(spark, sf_dir, tmp_path):
    stream, batch = source(spark, sf_dir, tmp_path, ["ts", "method", "path", "status"])
    found = sorted(tuple(r) for r in run(spark, rate_stream(stream), "rates", "update").collect())
    assert found == sorted(tuple(r) for r in metrics.rate(batch).collect())


def in_order(spark, sf_dir, tmp_path, columns, order, files=3):
    """A stream of files, one a micro-batch, each after the one before in ``order``, and the same as a table."""
    path, rows = str(tmp_path / "parts"), view(spark, sf_dir, "log").select(*columns)
    table = rows.toPandas().sort_values(order, ignore_index=True)
    for k in range(files):
        part = table.iloc[len(table) * k // files : len(table) * (k + 1) // files]
        spark.createDataFrame(part, rows.schema).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)  # files are taken by their time
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path), spark.createDataFrame(table, rows.schema)


def test_state_goes_on_over_micro_batches(spark, sf_dir, tmp_path):
    at = (F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("at")
    stream, batch = in_order(spark, sf_dir, tmp_path, [F.col("user_id").alias("key"), "event_id", at], ["at", "event_id"])
    found = {(r.key, r.event_id, r.admitted) for r in drained(token_bucket_stream(stream, 0.0001, 2.0)).collect()}
    assert found == {(r.key, r.event_id, r.admitted) for r in limits.token_bucket(batch, 0.0001, 2.0).collect()}
    idle = drained(token_bucket_stream(stream, 0.0001, 2.0, idle="1 day"))
    times, want = {}, set()
    for r in batch.orderBy("at").collect():
        times.setdefault(r.key, []).append(round(r.at * 1_000_000) // 1000)
    newest = max(map(max, times.values()))
    for key, ms in times.items():
        want |= {(key, a + 86_400_000) for a, b in zip(ms, [*ms[1:], newest]) if b > a + 86_400_000}
    assert {(r.key, r.expired_ms) for r in idle.where("event_id IS NULL").collect()} == want and want


def test_hysteresis_and_scans_over_micro_batches(spark, sf_dir, tmp_path):
    second = F.unix_seconds(F.col("ts").cast("timestamp"))
    value = F.floor(F.col("latency_s") * 40).cast("long").alias("value")
    stream, batch = in_order(spark, sf_dir, tmp_path, [(F.col("user_id") % 5).alias("probe"), F.col("event_id").alias("at"), value], ["at"])
    found = sorted(tuple(r) for r in drained(streams.hysteresis_stream(stream, 900, 0.1)).collect())
    columns = ("probe", "at", "value", "ok", "recovering")
    assert found == sorted(tuple(r) for r in limits.hysteresis(batch, 900, 0.1).select(*columns).collect())
    stream, batch = in_order(spark, sf_dir, tmp_path / "scans", [(F.col("user_id") % 8).alias("node"), second.alias("second")], ["second"])
    found = sorted(tuple(r) for r in drained(streams.eviction_scans_stream(stream, 86400)).collect())
    assert found == sorted(tuple(r) for r in origin.eviction_scans(batch, 86400).collect())


def test_forgotten_nodes_scan_again(spark, tmp_path):
    path = str(tmp_path / "writes")
    add = lambda second: spark.createDataFrame([(1, second)], "node long, second long").coalesce(1).write.mode("append").parquet(path)
    add(100)
    stream = spark.readStream.schema("node long, second long").parquet(path)
    query = streams.eviction_scans_stream(stream, 60, keep="3 seconds").writeStream.format("memory").queryName("scans").outputMode("append").start()

    def wait(n):
        end = time.time() + 60
        while spark.table("scans").count() < n and time.time() < end:
            time.sleep(0.3)

    try:
        wait(1)
        time.sleep(5)
        add(110)  # within the interval, but the node has been forgotten
        wait(2)
    finally:
        query.stop()
    assert sorted(r.second for r in spark.table("scans").collect()) == [100, 110]
