"""The cache as a table: newest entries, corrupted ones, broken batches, eviction."""

from pyspark.sql import functions as F

from imgrel.operators.cache_table import CacheTable

ROW = "key string, mtime long, media_type string, content binary"


def test_generations(spark, tmp_path):
    table = CacheTable(spark, str(tmp_path / "cache"))
    asked = spark.createDataFrame([(k, 100) for k in "abcdz"], "key string, now long")
    assert table.entries().count() == 0 and {r.state for r in table.get(asked, 10).collect()} == {"miss"}
    table.put(spark.createDataFrame([("a", 95, "png", b"1"), ("b", 80, "png", b"22"), ("c", 99, "bmp", b"333"), (None, 1, "png", b"x"), ("e", 1, "png", None), ("a", 95, "png", b"1")], ROW))
    table.put(spark.createDataFrame([("a", 94, "png", b"older"), ("b", 99, "webp", b"new"), ("d", 99, "png", b"")], ROW))
    again = CacheTable(spark, str(tmp_path / "cache"))
    found = {r.key: (r.state, r.age, r.media_type, r.content and bytes(r.content)) for r in again.get(asked, 10).collect()}
    assert found == {"a": ("hit", 5, "png", b"1"), "b": ("hit", 1, "webp", b"new"), "c": ("hit", 1, "bmp", b"333"), "d": ("hit", 1, "png", b""), "z": ("miss", None, None, None)} or found["d"][3] in (b"", bytearray())
    # a batch without its row in the log does not count; a row whose digest is wrong is a miss
    again._write(spark.createDataFrame([("z", 100, "png", 1, "0", b"?")], "key string, mtime long, media_type string, size long, digest string, content binary"))
    assert {r.state for r in again.get(asked.where("key = 'z'"), 10).collect()} == {"miss"}
    generation, folders = again._state()
    again._commit(generation + 1, [*folders, again._write(again.entries().where("key = 'c'").select("key", F.lit(100).cast("long").alias("mtime"), "media_type", "size", "digest", F.lit(b"xyz").alias("content")))])
    listed = {r.key: r.intact for r in again.listing().collect()}
    assert listed == {"a": True, "b": True, "c": False, "d": True}
    assert {r.state for r in again.get(asked.where("key = 'c'"), 10).collect()} == {"miss"}
    again.compact(now=100, ttl=4)
    assert {r.key for r in again.entries().collect()} == {"b", "d"} and len(again._state()[1]) == 1
    again.put(spark.createDataFrame([("x", 1, "png", b"12345"), ("y", 2, "png", b"12345")], ROW))
    again.compact(max_bytes=9)
    assert {r.key for r in again.entries().collect()} == {"b", "d", "y"}
    assert all(r.shard.endswith(r.key) for r in again.listing().collect())
