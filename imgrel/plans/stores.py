"""Queries over stored objects and a persistent cache, made of the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.cache_table import CacheTable
from ..sources import store
from ..sources.storage import fresh_path
from ..sources.views import duck, view


def s2_store(spark, sf):
    """Objects written to a store and asked for by key: found, missing, over the limit, or no key of an object."""
    spark.dataSource.register(store.ImageStore)
    root, blob = fresh_path(spark), view(spark, sf, "blob")
    kept = blob.where("doc_id % 5 <> 1").select(F.col("object_key").alias("key"), F.col("body").cast("binary").alias("content"))
    kept.write.format("imgrel").mode("append").save(root)
    asked = blob.select("doc_id", F.when(F.col("doc_id") % 5 == 2, F.concat(F.lit("../"), "object_key")).otherwise(F.col("object_key")).alias("key"))
    return store.fetch(asked, root, max_bytes=3000).select("doc_id", "status", "length", F.sha2("content", 256).alias("digest"))


S2 = duck("blob") + """SELECT doc_id, (CASE WHEN doc_id % 5 = 2 THEN 400 WHEN doc_id % 5 = 1 THEN 404 WHEN strlen(body) > 3000 THEN 413 ELSE 200 END)::INTEGER AS status,
  CASE WHEN doc_id % 5 NOT IN (1, 2) THEN strlen(body) END AS length, CASE WHEN doc_id % 5 NOT IN (1, 2) AND strlen(body) <= 3000 THEN sha256(body) END AS digest FROM blob"""


def c4_table(spark, sf):
    """A cache after two batches, a lookup and an eviction."""
    cache, blob = CacheTable(spark, fresh_path(spark)), view(spark, sf, "blob")
    entry = lambda mtime, body: blob.select(
        "doc_id", F.sha2("object_key", 256).alias("key"), mtime.cast("long").alias("mtime"), F.lit("png").alias("media_type"), body.cast("binary").alias("content"))
    cache.put(entry(F.col("mtime"), F.col("body")).where("doc_id % 4 > 0"))
    cache.put(entry(F.col("mtime") + F.col("doc_id") % 7 - 3, F.concat(F.lit("new "), "body")).where("doc_id % 3 = 0"))
    asked = blob.select("doc_id", F.sha2("object_key", 256).alias("key"), F.lit(5000).cast("long").alias("now"))
    found = cache.get(asked, ttl=3600).select("doc_id", "state", "age", F.sha2("content", 256).alias("digest"))
    cache.compact(max_bytes=1_000_000)
    left = cache.listing().select(F.col("key").alias("left_key"))
    keys = blob.select(F.col("doc_id").alias("id"), F.sha2("object_key", 256).alias("key")).join(left, F.col("key") == F.col("left_key"), "left")
    return found.join(keys.select("id", F.col("left_key").isNotNull().alias("kept")), F.col("doc_id") == F.col("id")).drop("id")


C4 = duck("blob") + """, p AS (SELECT doc_id, sha256(object_key) AS key, mtime, body FROM blob WHERE doc_id % 4 > 0
  UNION ALL SELECT doc_id, sha256(object_key), mtime + doc_id % 7 - 3, 'new ' || body FROM blob WHERE doc_id % 3 = 0),
n AS (SELECT DISTINCT ON (key) * FROM p ORDER BY key, mtime DESC, sha256(body) DESC),
r AS (SELECT *, coalesce(sum(strlen(body)) OVER (ORDER BY mtime, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(strlen(body)) OVER () AS total FROM n)
SELECT b.doc_id, CASE WHEN r.key IS NULL THEN 'miss' WHEN 5000 - r.mtime <= 3600 THEN 'hit' ELSE 'stale' END AS state, CASE WHEN 5000 - r.mtime <= 3600 THEN 5000 - r.mtime END AS age,
  CASE WHEN 5000 - r.mtime <= 3600 THEN sha256(r.body) END AS digest, coalesce(total - before <= 1000000, false) AS kept FROM blob b LEFT JOIN r ON r.doc_id = b.doc_id"""

QUERIES = {"s2_store": (s2_store, S2), "c4_table": (c4_table, C4)}
