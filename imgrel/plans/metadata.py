"""Queries over the metadata in JPEG, PNG and WebP files: read, kept, dropped and put in."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import containers
from ..operators import encode
from ..sources.views import duck, view

_JPEG = "head || seg_exif || seg_icc || seg_xmp || seg_iptc || seg_com || rest"
_FIELDS = ("exif", "icc", "xmp", "iptc")


def _jpegs(spark, sf):
    """JPEG files; every third with fill bytes before its first segment."""
    file = F.expr(_JPEG)
    filled = F.concat(F.substring(file, 1, 4), F.when(F.col("req_id") % 3 == 0, "FFFF").otherwise(""), F.substr(file, F.lit(5), F.length(file)))
    return view(spark, sf, "carrier").withColumn("content", F.unhex(filled)).withColumn("parts", containers.parts("content", F.lit("jpeg")))


def m2_metadata(spark, sf):
    """What is read from JPEG files, profiles in two segments that stand in the wrong order."""
    read = _jpegs(spark, sf).select("req_id", containers.metadata("content", F.lit("jpeg")).alias("m"))
    return read.select("req_id", *(F.hex(f"m.{name}").alias(name) for name in _FIELDS))


M2 = duck("carrier") + "SELECT req_id, exif, icc, xmp, iptc FROM carrier"


def e14_segments(spark, sf):
    """JPEG files by metadata policy, without fill bytes and with all that follows the scan."""
    return _jpegs(spark, sf).select("req_id", F.hex(containers.rewrite_jpeg(F.col("content"), F.col("parts"), F.col("policy"))).alias("content"))


E14 = duck("carrier") + """SELECT req_id, head || CASE WHEN policy IN ('keep_all', 'preserve_exif') THEN seg_exif ELSE '' END || CASE WHEN policy IN ('keep_all', 'preserve_icc') THEN seg_icc ELSE '' END
  || CASE policy WHEN 'keep_all' THEN seg_xmp || seg_iptc || seg_com ELSE '' END || rest AS content FROM carrier"""


def e13_passthrough(spark, sf):
    req = view(spark, sf, "req").withColumn("orientation", F.when(F.col("req_id") % 3 > 0, F.col("req_id") % 3))
    wide = req.withColumns({
        "width": F.when(F.col("req_id") % 40 == 0, F.col("width")), "height": F.when(F.col("req_id") % 40 == 0, F.col("height")),
        "format": F.when(F.col("req_id") % 9 == 3, "avif").otherwise("jpeg"), "input_type": F.when(F.col("req_id") % 7 > 0, "jpeg").otherwise(F.col("input_type")),
        "optimize": F.when(F.col("req_id") % 5 > 0, "lossless").otherwise("auto"), "quality": F.when(F.col("req_id") % 31 == 0, F.col("quality")),
    })
    return wide.select("req_id", encode.passthrough(wide).alias("outcome"))


E13 = duck("req") + """SELECT req_id, CASE WHEN req_id % 5 = 0 THEN NULL WHEN req_id % 9 = 3 THEN 'CapabilityMissing'
  WHEN (req_id % 7 > 0 OR input_type = 'jpeg') AND NOT (req_id % 40 = 0 AND coalesce(width, height) IS NOT NULL) AND NOT (req_id % 31 = 0 AND quality IS NOT NULL)
    AND background IS NULL AND crop_width IS NULL AND blur IS NULL AND sharpen IS NULL AND rotate = 0 AND NOT (auto_orient AND req_id % 3 = 2)
  THEN 'passthrough' ELSE 'CapabilityMissing' END AS outcome FROM req"""


def m4_injected(spark, sf):
    """XMP and IPTC put into JPEG files that have none, and what a file of another type could not take."""
    kind = F.when(F.col("req_id") % 6 == 5, "bmp").otherwise("jpeg")
    bare = view(spark, sf, "carrier").select("req_id", kind.alias("kind"), F.unhex(F.concat("head", "rest")).alias("content"), F.struct(
        *(F.unhex(name).alias(name) for name in _FIELDS)).alias("meta"))
    made = bare.withColumn("made", encode.inject(F.col("content"), F.col("kind"), F.col("meta")))
    return made.select("req_id", F.hex("made.content").alias("content"), F.array_join("made.dropped", ",").alias("dropped"))


M4 = duck("carrier") + """, s AS (SELECT *, CASE WHEN iptc IS NULL THEN '' ELSE 'FFED' || lpad(hex(CAST(floor((length(iptc) / 2 + 1) / 2) AS BIGINT) * 2 + 28), 4, '0')
  || hex('Photoshop 3.0') || '00' || hex('8BIM') || '04040000' || lpad(hex(CAST(length(iptc) / 2 AS BIGINT)), 8, '0') || iptc || CASE WHEN length(iptc) % 4 = 2 THEN '00' ELSE '' END END AS record FROM carrier)
SELECT req_id, CASE WHEN req_id % 6 = 5 THEN head || rest ELSE 'FFD8' || seg_xmp || record || substr(head, 5) || rest END AS content,
  CASE WHEN req_id % 6 = 5 THEN concat_ws(',', CASE WHEN xmp IS NOT NULL THEN 'XMP' END, CASE WHEN iptc IS NOT NULL THEN 'IPTC' END) ELSE '' END AS dropped FROM s"""


def m7_webp(spark, sf):
    """Metadata put into WebP files, simple ones made extended; what a file has already stays."""
    file = view(spark, sf, "webp").withColumns({n: F.unhex(n) for n in ("content", "exif", "icc", "xmp")})
    return file.select("req_id", F.hex(containers.inject_webp("content", "icc", "exif", "xmp")).alias("content"))


M7 = duck("webp") + """, c AS (SELECT *, CASE WHEN icc IS NULL THEN '' ELSE '49434350' || lpad(hex(CAST(length(icc) / 2 AS BIGINT)), 2, '0') || '000000' || icc || CASE WHEN length(icc) % 4 = 2 THEN '00' ELSE '' END END AS c_icc,
  '45584946' || lpad(hex(CAST(length(exif) / 2 AS BIGINT)), 2, '0') || '000000' || exif || CASE WHEN length(exif) % 4 = 2 THEN '00' ELSE '' END AS c_exif FROM webp),
b AS (SELECT req_id, '565038580A000000' || CASE shape WHEN 1 THEN CASE WHEN icc IS NULL THEN '1C' ELSE '3C' END WHEN 2 THEN CASE WHEN icc IS NULL THEN '1C' ELSE '3C' END
  ELSE CASE WHEN icc IS NULL THEN '0C' ELSE '2C' END END || '000000' || '090000' || '130000' || c_icc || image || c_exif
  || CASE shape WHEN 2 THEN after ELSE '584D50200A000000' || xmp END AS body FROM c)
SELECT req_id, '52494646' || lpad(hex(CAST(length(body) / 2 AS BIGINT) + 4), 2, '0') || '000000' || '57454250' || body AS content FROM b"""

QUERIES = {
    "m2_metadata": (m2_metadata, M2), "m4_injected": (m4_injected, M4), "m7_webp": (m7_webp, M7),
    "e13_passthrough": (e13_passthrough, E13), "e14_segments": (e14_segments, E14),
}
