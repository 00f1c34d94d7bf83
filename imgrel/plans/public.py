"""Queries over public requests, watermark payloads and client rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import public
from ..sources.views import duck, view

# the query text of a request, put together from its options; both engines read it
_TEXT = """concat_ws('&', CASE WHEN req_id % 23 > 0 THEN 'path=%2Fp%2F' || CAST(req_id AS VARCHAR(20)) || '.png' END,
  CASE WHEN req_id % 19 = 4 THEN 'bogus=1' END, CASE WHEN req_id % 29 = 3 THEN 'path=x&path=y' END,
  CASE WHEN width IS NOT NULL THEN 'width=' || CASE WHEN req_id % 31 = 7 THEN 'w' ELSE CAST(width AS VARCHAR(20)) END END,
  CASE WHEN height IS NOT NULL THEN 'height=' || CAST(height AS VARCHAR(20)) END, CASE WHEN fit IS NOT NULL THEN 'fit=' || CASE WHEN req_id % 37 = 0 THEN 'Fill' ELSE fit END END,
  CASE WHEN req_id % 7 = 1 THEN 'format=' || CASE WHEN req_id % 3 = 0 THEN 'jpg' ELSE 'gif' END END, CASE WHEN quality IS NOT NULL THEN 'quality=' || CAST(quality * 4 AS VARCHAR(20)) END,
  'rotate=' || CASE WHEN req_id % 41 = 9 THEN '45' WHEN req_id % 43 = 9 THEN '65536' ELSE CAST(rotate AS VARCHAR(20)) END,
  CASE WHEN req_id % 2 = 0 THEN 'autoOrient=' || CASE WHEN req_id % 47 = 2 THEN 'yes' ELSE 'false' END END, CASE WHEN blur IS NOT NULL THEN 'blur=' || CAST(req_id % 9 AS VARCHAR(20)) || '.5' END,
  CASE WHEN req_id % 17 = 5 THEN 'watermarkMargin=7' END, CASE WHEN req_id % 34 = 5 THEN 'watermarkUrl=https%3A%2F%2Fe.com%2Fw.png' END,
  CASE WHEN preset IS NOT NULL THEN 'preset=' || preset END)"""
_ERROR = """CASE WHEN req_id % 29 = 3 THEN 'query parameter `path` must not be repeated' WHEN req_id % 19 = 4 THEN 'query parameter `bogus` is not supported for this endpoint'
  WHEN req_id % 23 = 0 THEN 'query parameter `path` is required' WHEN req_id % 34 = 22 THEN 'watermarkPosition, watermarkOpacity, and watermarkMargin require watermarkUrl'
  WHEN width IS NOT NULL AND req_id % 31 = 7 THEN 'query parameter `width` must be an integer' WHEN quality * 4 > 255 THEN 'query parameter `quality` must be an integer'
  WHEN req_id % 41 <> 9 AND req_id % 43 = 9 THEN 'rotate must be 0, 90, 180, or 270' WHEN req_id % 2 = 0 AND req_id % 47 = 2 THEN 'query parameter `autoOrient` must be `true` or `false`'
  WHEN preset = 'missing' THEN 'unknown preset `missing`' WHEN fit IS NOT NULL AND req_id % 37 = 0 THEN 'fit: unsupported fit mode `Fill`'
  WHEN req_id % 7 = 1 AND req_id % 3 <> 0 THEN 'format: unsupported media type `gif`' WHEN req_id % 41 = 9 THEN 'rotate: unsupported rotation `45`' END"""


def p8_public(spark, sf):
    asked = view(spark, sf, "req").select("req_id", F.expr(_TEXT).alias("query"))
    presets = spark.createDataFrame([("thumb", "fill", "webp"), ("hero", None, "avif")], "name string, fit string, format string")
    columns = ("req_id", "error", "source", "width", "height", "fit", "format", "quality", "rotate", "auto_orient", "strip_metadata", "blur", "watermark_url", "watermark_margin")
    return public.public_requests(asked, "query", "path", presets).select(*columns)


P8 = duck("req") + f""", e AS (SELECT *, {_ERROR} AS error FROM req)
SELECT req_id, error, CASE WHEN error IS NULL THEN '/p/' || req_id || '.png' END AS source, CASE WHEN error IS NULL THEN width END AS width, CASE WHEN error IS NULL THEN height END AS height,
  CASE WHEN error IS NULL THEN coalesce(fit, CASE preset WHEN 'thumb' THEN 'fill' END) END AS fit,
  CASE WHEN error IS NULL THEN coalesce(CASE WHEN req_id % 7 = 1 THEN 'jpeg' END, CASE preset WHEN 'thumb' THEN 'webp' WHEN 'hero' THEN 'avif' END) END AS format,
  CASE WHEN error IS NULL THEN quality * 4 END AS quality, CASE WHEN error IS NULL THEN rotate END AS rotate, CASE WHEN error IS NULL THEN req_id % 2 = 1 END AS auto_orient,
  CASE WHEN error IS NULL THEN true END AS strip_metadata, CASE WHEN error IS NULL AND blur IS NOT NULL THEN req_id % 9 + 0.5::DOUBLE END AS blur,
  CASE WHEN error IS NULL AND req_id % 34 = 5 THEN 'https://e.com/w.png' END AS watermark_url, (CASE WHEN error IS NULL AND req_id % 17 = 5 THEN 7 END)::BIGINT AS watermark_margin FROM e"""


def p14_watermark(spark, sf):
    req = view(spark, sf, "req")
    url = F.when(F.col("req_id") % 10 > 0, F.concat(F.lit("https://e.com/"), F.col("source_path"))).when(F.col("req_id") % 20 == 0, "")
    place = F.when(F.col("req_id") % 26 == 12, "middle").otherwise(F.col("position"))
    payload = public.watermark_payload(
        F.col("req_id") % 6 > 0, url, place, F.when(F.col("req_id") % 3 > 0, F.col("req_id") % 128), F.when(F.col("req_id") % 4 > 0, F.col("req_id") * 13 % 12000))
    return req.select("req_id", payload.alias("w")).select("req_id", "w.*")


P14 = duck("req") + """, w AS (SELECT req_id, req_id % 6 > 0 AS present, CASE WHEN req_id % 10 > 0 THEN 'https://e.com/' || source_path END AS url,
  CASE WHEN req_id % 26 = 12 THEN 'middle' ELSE position END AS position, CASE WHEN req_id % 3 > 0 THEN req_id % 128 ELSE 50 END AS opacity, CASE WHEN req_id % 4 > 0 THEN req_id * 13 % 12000 ELSE 10 END AS margin FROM req),
e AS (SELECT *, CASE WHEN NOT present THEN NULL WHEN url IS NULL THEN 'watermark.url is required when watermark is present' WHEN position = 'middle' THEN 'watermark.position: unsupported position `middle`'
  WHEN opacity = 0 OR opacity > 100 THEN 'watermark.opacity must be between 1 and 100' WHEN margin > 9999 THEN 'watermark.margin must be at most 9999' END AS error FROM w)
SELECT req_id, CASE WHEN present AND error IS NULL THEN url END AS url, CASE WHEN present AND error IS NULL THEN coalesce(position, 'bottom-right') END AS position,
  (CASE WHEN present AND error IS NULL THEN opacity END)::BIGINT AS opacity, (CASE WHEN present AND error IS NULL THEN margin END)::BIGINT AS margin, error FROM e"""


def v30_client(spark, sf):
    req = view(spark, sf, "req")
    return req.groupBy(public.client_error(req).alias("error")).agg(F.count(F.lit(1)).alias("n"))


V30 = duck("req") + """SELECT CASE WHEN fit IS NOT NULL AND (width IS NULL OR height IS NULL) THEN 'fit requires both width and height'
  WHEN position IS NOT NULL AND (width IS NULL OR height IS NULL) THEN 'position requires both width and height'
  WHEN preserve_exif AND strip_metadata THEN 'preserveExif requires stripMetadata to be false'
  WHEN optimize <> 'none' AND format IN ('svg', 'bmp', 'tiff') THEN 'optimization is not supported for ' || format || ' output'
  WHEN optimize = 'lossy' AND format = 'png' THEN 'lossy optimization requires jpeg, webp, or avif output, got png'
  WHEN preserve_exif AND format = 'svg' THEN 'preserveExif is not supported with SVG output'
  WHEN quality IS NOT NULL AND format NOT IN ('jpeg', 'webp', 'avif') THEN 'quality requires a lossy output format'
  WHEN quality IS NOT NULL AND optimize = 'lossless' THEN 'quality cannot be combined with optimize=lossless'
  WHEN target_metric IS NOT NULL AND optimize IN ('none', 'lossless') THEN 'targetQuality requires optimize=auto or optimize=lossy'
  WHEN target_metric IS NOT NULL AND format NOT IN ('jpeg', 'webp', 'avif') THEN 'targetQuality requires jpeg, webp, or avif output' END AS error, count(*) AS n FROM req GROUP BY 1"""

QUERIES = {"p8_public": (p8_public, P8), "p14_watermark": (p14_watermark, P14), "v30_client": (v30_client, V30)}
