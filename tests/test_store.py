"""A folder as a store of objects: two-phase writes, and keys read with a status."""

import os

import pytest
from pyspark.sql import functions as F

from imgrel.sources import store


@pytest.fixture(autouse=True)
def _registered(spark):
    spark.dataSource.register(store.ImageStore)


def files_of(path):
    return sorted(os.path.relpath(os.path.join(d, n), path) for d, _, names in os.walk(path) for n in names)


def rows_of(spark, n, parts=3):
    return spark.range(n).select(F.concat(F.lit("a/"), F.col("id").cast("string"), F.lit(".png")).alias("key"), F.encode(F.repeat(F.lit("x"), F.col("id").cast("int")), "UTF-8").alias("content")).repartition(parts)


def test_written_and_read_back(spark, tmp_path):
    root = str(tmp_path / "store")
    rows_of(spark, 20).write.format("imgrel").mode("append").save(root)
    assert files_of(root) == sorted(f"a/{k}.png" for k in range(20))
    read = spark.read.format("imgrel").option("splitBytes", 40).load(root)
    assert {(r.key, r.status, r.length, bytes(r.content)) for r in read.collect()} == {(f"a/{k}.png", 200, k, b"x" * k) for k in range(20)}
    assert read.rdd.getNumPartitions() > 3
    capped = {r.key: (r.status, r.content) for r in spark.read.format("imgrel").option("maxBytes", 10).load(root).collect()}
    assert capped["a/10.png"][0] == 200 and capped["a/11.png"] == (413, None)
    rows_of(spark, 2).write.format("imgrel").mode("overwrite").save(root)
    assert files_of(root) == ["a/0.png", "a/1.png"]
    assert spark.read.format("imgrel").load(str(tmp_path / "nothing")).count() == 0


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    root = str(tmp_path / "store")
    rows_of(spark, 3).write.format("imgrel").mode("append").save(root)
    bad = rows_of(spark, 30).withColumn("key", F.when(F.col("key") == "a/17.png", "../out.png").otherwise(F.concat(F.lit("b/"), "key")))
    with pytest.raises(Exception, match="relative segments"):
        bad.write.format("imgrel").mode("append").save(root)
    assert files_of(root) == ["a/0.png", "a/1.png", "a/2.png"] and not os.path.exists(f"{root}/_staging") and not os.path.exists(tmp_path / "out.png")
    twice = rows_of(spark, 5).withColumn("key", F.lit("c/same.png"))
    with pytest.raises(Exception, match="several rows"):
        twice.write.format("imgrel").mode("append").save(root)
    assert files_of(root) == ["a/0.png", "a/1.png", "a/2.png"]


def test_keys_have_a_status(spark, tmp_path):
    root = str(tmp_path / "store")
    rows_of(spark, 6).write.format("imgrel").mode("append").save(root)
    keys = [(1, "a/3.png"), (2, "a/9.png"), (3, "a"), (4, "../x"), (5, None), (6, ""), (7, "a/5.png"), (8, "a//3.png"), (9, "/etc/passwd"), (10, "a/3.png")]
    found = {r.status_: (r.status, r.length, r.content and bytes(r.content)) for r in store.fetch(spark.createDataFrame(keys, "status_ int, key string"), root, max_bytes=4).collect()}
    assert found == {
        1: (200, 3, b"xxx"), 2: (404, None, None), 3: (404, None, None), 4: (400, None, None), 5: (400, None, None), 6: (400, None, None),
        7: (413, 5, None), 8: (400, None, None), 9: (400, None, None), 10: (200, 3, b"xxx"),
    }

    class Denying:
        def get_file_info(self, path):
            raise PermissionError(path)

    class Broken:
        def get_file_info(self, path):
            raise OSError("unreachable")

    assert store.read_object(Denying(), "r", "k", 9)[0] == 403 and store.read_object(Broken(), "r", "k", 9)[0] == 502


def test_a_key_is_read_without_a_listing(spark, tmp_path):
    root = str(tmp_path / "store")
    rows_of(spark, 4).write.format("imgrel").mode("append").save(root)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        found = spark.read.format("imgrel").option("pushKeys", "true").load(root).where("key = 'a/3.png' AND status = 200")
        assert [(r.key, r.length) for r in found.collect()] == [("a/3.png", 3)] and found.rdd.getNumPartitions() == 1
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    reader = store.ImageStore({"path": root, "pushKeys": "true"}).reader(None)
    left = list(reader.pushFilters([store.EqualTo(("key",), "a/2.png"), store.EqualTo(("status",), 200)]))
    assert left == [store.EqualTo(("status",), 200)] and [p.keys for p in reader.partitions()] == [["a/2.png"]]
    assert [tuple(r) for r in reader.read(reader.partitions()[0])] == [("a/2.png", 200, 2, b"xx")]
