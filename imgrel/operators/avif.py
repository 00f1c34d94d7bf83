"""Sizes and alpha of AVIF files from their tree of boxes, level by level.

A round lists the boxes of all containers of one level; those that are
containers themselves make the next round.  Only the bytes inside containers
go on, never the coded image.  Boxes stand in the file in the order in which a
reader meets them, so what comes first is what has the smallest offset.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import media, tables
from ..sources.storage import written

# Boxes that hold boxes, two of them after four bytes of their own, and the text that names an alpha plane.
CONTAINERS, FULL = ("meta", "iref", "iprp", "ipco"), ("meta", "iref")
ALPHA = "urn:mpeg:mpegB:cicp:systems:auxiliary:alpha"


def boxes(files: DataFrame) -> DataFrame:
    """All boxes of ``files`` (id, content) as ``(id, kind, at, depth, error, body)``; ``body`` of those that are read, else null."""
    spark = files.sparkSession
    tables.register(spark)
    level, found, depth = files.select("id", F.lit(0).cast("long").alias("start"), "content"), None, 0
    while True:
        name = f"containers_{uuid.uuid4().hex}"
        level.createOrReplaceTempView(name)
        listed = spark.sql(f"SELECT c.id, c.start, b.*, c.content FROM {name} c, LATERAL mp4_boxes(c.content) b")
        spark.catalog.dropTempView(name)
        body = F.substr("content", (F.col("body") + 1).cast("int"), (F.col("next") - F.col("body")).cast("int"))
        read = F.col("kind").isin(*CONTAINERS, "ispe", "auxC")
        size = F.col("next") - F.col("body")
        error = (
            F.when(F.col("error").isNotNull(), F.col("error"))
            .when(F.col("kind").isin(*FULL) & (size < 4), F.concat("kind", F.lit(" box is too short")))
            .when((F.col("kind") == "ispe") & (size < 12), "avif ispe box is too short").when((F.col("kind") == "auxC") & (size < 5), "avif auxC box is too short")
        )
        rows = written(listed.select(
            "id", "kind", (F.col("start") + F.col("at")).alias("at"), F.lit(depth).alias("depth"), error.alias("error"),
            F.when(read, body).alias("body"), (F.col("start") + F.col("body")).alias("inside"),
        ))
        found = rows.drop("inside") if found is None else found.unionByName(rows.drop("inside"))
        own = F.when(F.col("kind").isin(*FULL), 4).otherwise(0)
        level = rows.where(F.col("kind").isin(*CONTAINERS) & F.col("error").isNull()).select(
            "id", (F.col("inside") + own).alias("start"), F.substr("body", own + 1, F.octet_length("body")).alias("content")
        )
        depth += 1
        if level.isEmpty():
            return found


def headers(files: DataFrame) -> DataFrame:
    """``(id, width, height, has_alpha, error)`` of ``files`` (id, content), one row for each id, which has to be unique.

    The first size counts; alpha is null in a file without structured
    metadata.  A file with an error has nothing but it, and of several errors
    the first.  ``content`` that is null or no AVIF gives an error too.
    """
    short = F.coalesce(F.octet_length("content") < 16, F.lit(True))
    brand = F.coalesce(media.sniff(F.col("content")) == "avif", F.lit(False))
    first = F.when(short, "avif file is too short").when(~brand, "avif file is missing a compatible AVIF brand")
    judged = files.select("id", "content", first.alias("first"))
    listed = boxes(judged.where("first IS NULL"))
    number = lambda at: F.conv(F.hex(F.substr("body", F.lit(at + 1), F.lit(4))), 16, 10).cast("long")
    size = F.when(F.col("kind") == "ispe", F.struct(number(4).alias("width"), number(8).alias("height")))
    urn = F.substr("body", F.lit(5), F.octet_length("body")) == F.concat(F.lit(ALPHA).cast("binary"), F.unhex(F.lit("00")))
    structured = F.col("kind").isin(*CONTAINERS, "ispe", "auxC", "auxl")
    found = listed.groupBy("id").agg(
        F.min_by("error", F.when(F.col("error").isNotNull(), F.col("at"))).alias("error"),
        F.min_by(size, F.when(F.col("kind") == "ispe", F.col("at"))).alias("size"),
        F.bool_or(structured).alias("structured"),
        F.bool_or(((F.col("kind") == "auxC") & urn) | (F.col("kind") == "auxl")).alias("alpha"),
    ).withColumnRenamed("id", "of_")
    whole = F.col("first").isNull() & F.col("error").isNull()
    return judged.select("id", "first").join(found, F.col("id") == F.col("of_"), "left").select(
        "id", F.when(whole, F.col("size.width")).alias("width"), F.when(whole, F.col("size.height")).alias("height"),
        F.when(whole & F.col("structured"), F.coalesce("alpha", F.lit(False))).alias("has_alpha"), F.coalesce("first", "error").alias("error"),
    )
