"""A cache as a table in a shared folder: entries by key, written in generations, the newest of a key counts.

A batch is a folder of its own; it counts once a row of the table ``log`` names
it, which is one small file put there by Spark's committer, so a batch that
breaks off is never seen.  ``compact`` writes what is alive as one folder and
names that alone.  An entry is known by the digest of its content; one that
does not match is corrupted, is a miss for readers, and goes with the next
compaction.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cache

SCHEMA = "key string, mtime long, media_type string, size long, digest string, content binary"
_LOG = "generation int, folders array<string>"


class CacheTable:
    """Entries ``(key, mtime, media_type, size, digest, content)``.  One job may write at a time."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _state(self) -> tuple[int, list[str]]:
        try:
            rows = self.spark.read.schema(_LOG).parquet(f"{self.path}/log")
            row = rows.orderBy(F.desc("generation")).first()
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            row = None
        return (row.generation, list(row.folders)) if row else (0, [])

    def _commit(self, generation: int, folders: list[str]) -> None:
        row = self.spark.range(1).select(F.lit(generation).alias("generation"), F.array(*map(F.lit, folders)).cast("array<string>").alias("folders"))
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/log")

    def _write(self, rows: DataFrame) -> str:
        folder = f"entries-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{folder}")
        return folder

    def entries(self, contents: bool = True) -> DataFrame:
        """The newest entry of each key, with ``intact``; of equally new ones the one with the largest digest."""
        _, folders = self._state()
        if not folders:
            return self.spark.createDataFrame([], f"{SCHEMA}, intact boolean")
        rows = self.spark.read.schema(SCHEMA).parquet(*(f"{self.path}/{f}" for f in folders))
        intact = F.coalesce((F.sha2("content", 256) == F.col("digest")) & (F.octet_length("content") == F.col("size")), F.lit(False))
        rows = rows.withColumn("intact", intact)
        newest = rows.groupBy("key").agg(F.max(F.struct("mtime", "digest", "intact")).alias("best"))
        if not contents:
            rows = rows.drop("content")
        named = newest.select(F.col("key").alias("key_"), "best")
        same = (F.col("key") == F.col("key_")) & (F.struct("mtime", "digest", "intact") == F.col("best"))
        return rows.join(named, same).drop("key_", "best").dropDuplicates(["key"])

    def put(self, rows: DataFrame) -> None:
        """Add ``rows`` (key, mtime, media_type, content); an older entry of a key than the one that is there changes nothing."""
        batch = rows.select("key", "mtime", "media_type", F.octet_length("content").cast("long").alias("size"), F.sha2("content", 256).alias("digest"), "content")
        generation, folders = self._state()
        self._commit(generation + 1, [*folders, self._write(batch.where("key IS NOT NULL AND content IS NOT NULL"))])

    def get(self, requests: DataFrame, ttl: int) -> DataFrame:
        """``requests`` (key, now) with ``state`` (hit, stale or miss), ``age``, and the entry's media_type and content for a hit."""
        alive = self.entries().where("intact").select(F.col("key").alias("entry_key"), "mtime", "media_type", "content")
        looked = cache.lookup(requests, alive.select(F.col("entry_key").alias("key"), "mtime"), ttl)
        return looked.join(alive.drop("mtime"), (F.col("key") == F.col("entry_key")) & (F.col("state") == "hit"), "left").drop("entry_key")

    def listing(self) -> DataFrame:
        """``(shard, key, mtime, size, intact)`` of all entries, with the folder that each would have in a file store."""
        rows = self.entries(contents=False)
        return rows.select(cache.shard(F.col("key")).alias("shard"), "key", "mtime", "size", "intact")

    def compact(self, now: int | None = None, ttl: int | None = None, max_bytes: int = 0) -> None:
        """Rewrite as one folder: corrupted entries go, those older than ``ttl``, and then the oldest until ``max_bytes`` hold the rest."""
        alive = self.entries().where("intact").drop("intact")
        if now is not None and ttl is not None:
            alive = alive.where(now - F.col("mtime") <= ttl)
        if max_bytes:
            gone = cache.evict(alive.select("key", "size", "mtime"), max_bytes).where("evicted").select("key")
            alive = alive.join(gone, "key", "left_anti").select(*(x.split()[0] for x in SCHEMA.split(", ")))
        generation, _ = self._state()
        self._commit(generation + 1, [self._write(alive)])
