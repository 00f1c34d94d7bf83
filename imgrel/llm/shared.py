"""Helpers that several operators use: shared storage, links, components."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key with more than one in so many rows is hot; at most so many keys can be.
HOT_SHARE = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@lru_cache(maxsize=None)
def _local_dir(application: str) -> str:
    return tempfile.mkdtemp(prefix="imgrel-")


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which driver and executors share.

    A local session that names none gets a temporary one; on a cluster that is
    an error, since executors would each write to a disk of their own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = _local_dir(context.applicationId)
    return folder.rstrip("/")


def materialize(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Write to the shared folder and reread: cuts lineage, survives lost executors.

    All that an application writes lies in one folder named after it, which may
    go when the application has ended.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/imgrel-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Buckets:
    """Tables bucketed and sorted by the same column, so that they are joined where they lie."""

    def __init__(self, spark: SparkSession, key: str):
        self.spark, self.key, self.run, self.names = spark, key, uuid.uuid4().hex, []
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def path(self, name: str) -> str:
        return f"{shared_dir(self.spark)}/{name}"

    def write(self, rows: DataFrame, compression: str = "snappy") -> DataFrame:
        name = f"buckets_{self.run}_{len(self.names)}"
        self.names.append(name)
        (rows.write.format("parquet").option("path", self.path(name)).option("compression", compression)
         .bucketBy(self.buckets, self.key).sortBy(self.key).saveAsTable(name))
        return self.spark.table(name)

    def files(self, at: int) -> DataFrame:
        """A table as files without buckets: a join with it is shuffled, and so may be split where a key is hot."""
        return self.spark.read.schema(self.spark.table(self.names[at]).schema).parquet(self.path(self.names[at]))

    def close(self) -> None:
        """Forget the catalog's entries; the data stay."""
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def look_up(rows: DataFrame, facts: DataFrame, key: str, copies: Column, share: int = HOT_SHARE) -> DataFrame:
    """``rows`` joined with ``facts``, which has one row for each ``key`` and the number of ``rows`` with it in ``copies``.

    Rows of hot keys never meet in one task: their facts, at most ``share`` of
    them whatever the input, are broadcast.  The others are joined by hash.
    """
    total = facts.agg(F.sum(copies)).first()[0] or 0
    hot = F.broadcast(facts.where(copies * share > total))
    usual = rows.join(hot.select(key), key, "left_anti").join(facts.where(copies * share <= total), key)
    return usual.unionByName(rows.join(hot, key))


def text_key(text: Column) -> Column:
    """What tells texts apart beside their doc_id: an MD5 of the bytes; null for a null text."""
    return F.unhex(F.md5(text.cast("binary")))


def keep_rows(docs: DataFrame, dropped: DataFrame, repeated: DataFrame) -> DataFrame:
    """``docs`` without the rows named in ``dropped``, and with one row for each of those named in ``repeated``.

    Both name rows by ``(doc_id, text_key)``, nulls included.  They grow with
    the input, so sorted rows are merged at every size, and texts are shuffled
    once: a broadcast of a small table would only hide that from a small run.
    """
    taken = set(docs.columns)
    key, other_id, other_key = (next(n for k in range(len(taken) + 1) if (n := f"{name}_{k}") not in taken) for name in ("key", "id", "other"))
    signed = docs.withColumn(key, text_key(F.col("text")))
    named = lambda df: df.select(F.col("doc_id").alias(other_id), F.col("text_key").alias(other_key)).hint("merge")
    same = F.col("doc_id").eqNullSafe(F.col(other_id)) & F.col(key).eqNullSafe(F.col(other_key))
    out = signed.join(named(dropped), same, "left_anti")
    if not repeated.isEmpty():
        once = out.join(named(repeated), same, "left_semi").dropDuplicates(["doc_id", key])
        out = out.join(named(repeated), same, "left_anti").unionByName(once)
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the links ``(a, b)``, two columns of one integer type.

    Returns ``(node, component)`` for each node that has a link; ``component``
    is the smallest node that can be reached.  Each round hooks every node to
    the smallest of its neighbours and itself, follows these parents a few
    steps, and contracts the graph, so hubs shrink by partial aggregation; the
    number of rounds grows with the logarithm of the longest chain.  The joins
    move two numbers a node, and each side that a hub repeats in meets one row
    of it: adaptive execution splits such a partition where it grows large.
    Nulls and self links are ignored.
    """
    edges = materialize(edges.where("a <> b").distinct())
    labels = None
    while not edges.isEmpty():
        both = edges.select("a", "b").union(edges.select("b", "a"))
        parents = both.groupBy("a").agg(F.min("b").alias("b")).select(
            F.col("a").alias("node"), F.least("a", "b").alias("parent")
        )
        parents = materialize(parents)
        for _ in range(2):
            above = parents.select(F.col("node").alias("parent"), F.col("parent").alias("next"))
            parents = parents.join(above, "parent").select("node", F.col("next").alias("parent"))
        parents = materialize(parents)
        if labels is None:
            labels = parents.select("node", F.col("parent").alias("component"))
        else:
            step = parents.select(F.col("node").alias("component"), "parent")
            labels = labels.join(step, "component", "left").select(
                "node", F.coalesce("parent", "component").alias("component")
            )
        labels = materialize(labels)
        left = parents.select(F.col("node").alias("a"), F.col("parent").alias("pa"))
        right = parents.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
        edges = materialize(
            edges.join(left, "a").join(right, "b").where("pa <> pb")
            .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()
        )
    if labels is None:
        labels = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels


def merge_labels(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Give linked positions one label, in place; a label is the smallest position of its group."""
    while len(i):
        a, b = labels[i], labels[j]
        differ = a != b
        if not differ.any():
            return
        i, j, a, b = i[differ], j[differ], a[differ], b[differ]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels[:] = up
