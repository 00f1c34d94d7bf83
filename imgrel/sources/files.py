"""Image files as rows.  The scheme of the path (file, s3a, gs, abfss, ...) decides the store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.media import MAX_SOURCE_BYTES, header


def images(spark: SparkSession, path: str, max_bytes: int = MAX_SOURCE_BYTES, pattern: str = "*") -> DataFrame:
    """``(path, modificationTime, length, content)`` of files up to ``max_bytes``; larger ones are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.where(F.col("length") <= max_bytes)


def listing(spark: SparkSession, path: str) -> DataFrame:
    """As ``images`` without contents, temporary files left out; no file is opened."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "modificationTime", "length")
    return found.where(~F.contains("path", F.lit(".tmp.")))


def inspect(files: DataFrame) -> DataFrame:
    """``path`` and a JSON description of what the header declares; null for an unknown format."""
    h = header(F.col("content"))
    described = files.select("path", h.alias("h"))
    mime = F.when(F.col("h.media_type") == "svg", "image/svg+xml").otherwise(F.concat(F.lit("image/"), F.col("h.media_type")))
    body = F.to_json(F.struct(
        F.col("h.media_type").alias("format"), mime.alias("mime"), F.col("h.width").alias("width"), F.col("h.height").alias("height"),
        F.col("h.has_alpha").alias("hasAlpha"), F.lit(False).alias("isAnimated"),
    ), {"ignoreNullFields": "false"})
    return described.select("path", F.when(F.col("h.media_type").isNotNull(), body).alias("body"))


def presets(spark: SparkSession, path: str) -> DataFrame:
    """Named option sets from JSON lines ``{"name": ..., "width": ...}`` with a fixed schema."""
    return spark.read.schema("name string, width long, height long, format string").json(path)
