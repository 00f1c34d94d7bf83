"""Operator 9: exact dedup against a persistent digest index.

The index is a table bucketed and sorted by the digest of the normalised text
(white space deleted, SHA-256).  A batch is reduced to one row for each
digest, anti-joined with the index by a sort-merge join, and what is new is
appended under the batch's name.  The buckets spare the index the shuffle;
Spark sorts each bucket again, since appends leave several files in it, until
``compact`` rewrites it.  Only digests, ids and lengths are shuffled, never
texts.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import keep_rows, look_up, materialize, shared_dir, table, text_key

SCHEMA = "digest BINARY, keep_id BIGINT, n_points BIGINT, batch STRING"


def normalized(text: Column) -> Column:
    """The text without the characters of ``[\\x20\\x09-\\x0D]``; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for char in " \n\t\r\x0b\x0c":
        out = F.replace(out, F.lit(char), F.lit(""))
    return out


def signatures(docs: DataFrame) -> DataFrame:
    """``(row_id, doc_id, text_key, digest, n_points)`` of every row."""
    return docs.select(
        F.monotonically_increasing_id().alias("row_id"), F.col("doc_id"), text_key(F.col("text")).alias("text_key"),
        F.unhex(F.sha2(F.encode(normalized(F.col("text")), "UTF-8"), 256)).alias("digest"),
        F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_points"),
    )


class DigestIndex:
    """A bucketed table ``(digest, keep_id, n_points, batch)`` of all texts seen so far.

    ``path`` is a shared folder; an index that lies there already is opened
    again, with the buckets that it was made with.  A new one gets ``buckets``
    of them, by default as many as the session has shuffle partitions, so that
    they grow with what a cluster is set up for.

    The data of each generation lie in a folder of their own; the table
    ``meta`` names the generations, and the last one counts.  So a compaction
    that breaks off leaves the index as it was.  One job may write at a time.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.path = (path or f"{shared_dir(spark)}/digest-index-{uuid.uuid4().hex}").rstrip("/")
        self.generation, self.buckets = self._last() or (0, buckets or int(spark.conf.get("spark.sql.shuffle.partitions")))
        self._open(self.generation)
        if not self._last():
            self._commit(0)

    def _last(self) -> tuple[int, int] | None:
        try:
            rows = self.spark.read.schema("generation int, buckets int").parquet(f"{self.path}/meta")
            row = rows.orderBy(F.desc("generation")).first()
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        return (row["generation"], row["buckets"]) if row else None

    def _commit(self, generation: int) -> None:
        row = self.spark.range(1).select(F.lit(generation).alias("generation"), F.lit(self.buckets).alias("buckets"))
        row.write.mode("append").parquet(f"{self.path}/meta")
        self.generation = generation

    def _folder(self, generation: int) -> str:
        return f"{self.path}/data-{generation}"

    def _open(self, generation: int) -> None:
        """One catalog table for each path and generation, however often it is opened."""
        self.name = f"digest_index_{hashlib.md5(self._folder(generation).encode()).hexdigest()}"
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} ({SCHEMA}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) "
            f"INTO {self.buckets} BUCKETS LOCATION '{self._folder(generation)}'"
        )
        self.spark.catalog.refreshTable(self.name)

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def _write(self, rows: DataFrame) -> None:
        (rows.select("digest", "keep_id", "n_points", "batch").repartition(self.buckets, "digest")
         .write.format("parquet").mode("append").option("path", self._folder(self.generation))
         .bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name))
        self.spark.catalog.refreshTable(self.name)

    def append(self, rows: DataFrame, batch: str) -> None:
        """Add the rows of a batch that are not there yet, so that it may be given again."""
        there = self.table().where(F.col("batch") == batch)
        if not there.isEmpty():
            rows = rows.join(there.hint("merge"), "digest", "left_anti")
        self._write(rows.withColumn("batch", F.lit(batch)))

    def compact(self) -> None:
        """Rewrite the index with one file for each bucket.  Batches keep their names, so they may still be given again."""
        # from the files: of a bucketed table Spark would leave out the repartition, and then not read by buckets
        rows, before = self.spark.read.schema(self.table().schema).parquet(self._folder(self.generation)), self.name
        self.generation += 1
        try:
            self._open(self.generation)
            self._write(rows)
            self._commit(self.generation)
        except BaseException:
            self.generation -= 1
            self.name = before
            raise
        self.spark.sql(f"DROP TABLE IF EXISTS {before}")

    def close(self) -> None:
        """Forget the catalog's entry; the data stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def _verdicts(docs: DataFrame, index: DigestIndex, batch: str | None) -> tuple[DataFrame, DataFrame]:
    """The signatures of all rows, and one row for each digest with the row that stays; appends what is new."""
    batch = batch or uuid.uuid4().hex
    rows = materialize(signatures(docs))
    order = F.struct(-F.col("n_points"), F.col("doc_id").isNull(), F.col("doc_id"), F.col("text_key"), F.col("row_id"))
    groups = materialize(rows.groupBy("digest").agg(
        F.min(order).alias("best"), F.count(F.lit(1)).alias("group_size")
    ).select(
        "digest", "group_size", F.col("best.doc_id").alias("keep_id"), (-F.col("best.col1")).alias("n_points"),
        F.col("best.text_key").alias("keep_key"), F.col("best.row_id").alias("keep_row"),
    ))
    # what the batch itself has appended, when it is given again, is new as before
    older = index.table().where(F.col("batch") != batch)
    fresh = materialize(groups.join(older.hint("merge"), "digest", "left_anti"))
    seen = groups.drop("keep_id").join(older.select("digest", "keep_id").hint("merge"), "digest")
    verdict = materialize(fresh.withColumn("fresh", F.lit(True)).unionByName(seen.withColumn("fresh", F.lit(False))))
    index.append(fresh, batch)
    return rows, verdict


def deduplicate(docs: DataFrame, index: DigestIndex, batch: str | None = None) -> DataFrame:
    """Every row of ``docs`` with its verdict, and the new texts appended to ``index``.

    Returns ``(row_id, doc_id, digest, n_points, keep_id, group_size, kept)``.
    Of equal texts in the batch the one with the most code points stays, then
    the smallest doc_id, then one of the repeated rows; a text that the index
    holds from another batch is not kept.  A null doc_id comes after all
    others.  Null texts count as empty and are equal to each other.
    ``group_size`` counts the batch's rows.  Other columns play no part, and an
    empty table gives an empty result.  A job that was lost may give its batch
    again under the same name, and gets the same verdicts.
    """
    rows, verdict = _verdicts(docs, index, batch)
    return look_up(rows, verdict.drop("n_points"), "digest", F.col("group_size")).select(
        "row_id", "doc_id", "digest", "n_points", "keep_id", "group_size",
        (F.col("fresh") & (F.col("row_id") == F.col("keep_row"))).alias("kept"),
    )


def keep_first(docs: DataFrame, index: DigestIndex, batch: str | None = None) -> DataFrame:
    """The rows of ``docs`` whose text is new, one for each text, with all their columns.

    Rows are found again by doc_id and text; rows repeated in both leave one.
    """
    rows, verdict = _verdicts(docs, index, batch)
    judged = look_up(rows, verdict.drop("n_points"), "digest", F.col("group_size"))
    same = F.col("doc_id").eqNullSafe(F.col("keep_id")) & F.col("text_key").eqNullSafe(F.col("keep_key"))
    gone = judged.where(~F.col("fresh") | (F.col("row_id") != F.col("keep_row")))
    gone = materialize(gone.select("doc_id", "text_key", (F.col("fresh") & same).alias("same")).distinct())
    return keep_rows(docs, gone.where("NOT same"), gone.where("same"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = DigestIndex(spark)
    verdicts = deduplicate(table(spark, sf_dir, "documents"), index)
    index.close()
    return verdicts.select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h
  FROM documents
), g AS (
  SELECT doc_id, h, count(*) OVER (PARTITION BY h) AS group_size,
         first_value(doc_id) OVER (PARTITION BY h ORDER BY n DESC, doc_id) AS keep_id
  FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM g
"""
