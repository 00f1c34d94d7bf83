"""JSON payloads in all their fields, of the server and of the browser."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import payloads
from ..sources.views import duck, view

#: Payloads that are refused, by what is left of req_id divided by 20, with their errors; ``{0}`` stands for how a field's error begins.
REFUSED = {
    1: ('{"width":1,"bogus":2}', "unknown field `bogus`"), 2: ('{"width":', "invalid JSON"), 3: ("[1]", "invalid JSON"), 4: ('{"width":"12"}', "invalid value for `width`"),
    5: ('{"quality":256}', "invalid value for `quality`"), 6: ('{"fit":"squash"}', "fit{0} unsupported fit mode `squash`"), 7: ('{"rotate":45}', "rotate{0} unsupported rotation `45`"),
    8: ('{"crop":"1,2,3"}', "crop{0} crop must be x,y,w,h (four comma-separated integers), got '1,2,3'"), 9: ('{"autoOrient":1}', "invalid value for `autoOrient`"),
    10: ('{"width":1,"width":2}', "invalid JSON"), 11: ('{"format":"gif","position":"middle"}', "position{0} unsupported position `middle`"), 12: ('{"blur":true}', "invalid value for `blur`"),
    13: ('{"targetQuality":"ssim"}', "targetQuality{0} targetQuality must be <metric>:<value>, for example ssim:0.98"), 14: ('{"background":"red"}', "background{0} unsupported color `red`"),
}


def _shown(spark, sf, browser):
    req, c = view(spark, sf, "req"), F.col
    flag = (~c("strip_metadata")).alias("keepMetadata") if browser else c("strip_metadata").alias("stripMetadata")
    whole = F.to_json(F.struct(
        "width", "height", "fit", "position", "format", "quality", "optimize", F.concat("target_metric", F.lit(":"), c("target_value").cast("string")).alias("targetQuality"),
        "background", "rotate", c("auto_orient").alias("autoOrient"), flag, c("preserve_exif").alias("preserveExif"),
        F.concat(F.lit("1,2,"), (c("crop_width") + 1).cast("string"), F.lit(","), (c("crop_height") + 1).cast("string")).alias("crop"), "blur", "sharpen",
    ))
    text = whole
    for k, (bad, _) in REFUSED.items():
        text = F.when(c("req_id") % 20 == k, bad).otherwise(text)
    found = payloads.options(req.select("req_id", text.alias("text")), "text", browser)
    return found.select(
        "req_id", *(F.col(f"options.{n}").alias(n) for n in ("width", "height", "fit", "position", "format", "quality", "optimize", "target_metric", "rotate", "auto_orient", "strip_metadata", "preserve_exif", "blur", "sharpen")),
        F.round("options.target_value", 4).alias("target_value"), F.concat_ws(",", *(F.col(f"options.background.{n}").cast("string") for n in "rgba")).alias("background"),
        F.concat_ws(",", *(F.col(f"options.crop.{n}").cast("string") for n in ("x", "y", "width", "height"))).alias("crop"), "error",
    )


def _sql(browser):
    cases = " ".join(f"WHEN {k} THEN '" + error.format(" is invalid:" if browser else ":").replace("'", "''") + "'" for k, (_, error) in REFUSED.items())
    clash = "WHEN NOT strip_metadata AND preserve_exif THEN 'keepMetadata and preserveExif cannot both be true' " if browser else ""
    strip = "strip_metadata AND NOT preserve_exif" if browser else "strip_metadata"
    byte = lambda k: f"('0x' || substr(background, {k}, 2))::BIGINT"
    return duck("req") + f""", e AS (SELECT *, CASE WHEN req_id % 20 BETWEEN 1 AND 14 THEN CASE req_id % 20 {cases} END {clash}END AS error FROM req),
o AS (SELECT e.req_id, e.error, g.* EXCLUDE (req_id) FROM e LEFT JOIN req g ON g.req_id = e.req_id AND e.error IS NULL)
SELECT req_id, width, height, fit, position, format, quality, optimize, target_metric, rotate, auto_orient, {strip} AS strip_metadata, preserve_exif, blur, sharpen,
  round(target_value, 4) AS target_value, coalesce({byte(1)} || ',' || {byte(3)} || ',' || {byte(5)} || ',' || CASE WHEN length(background) = 8 THEN {byte(7)} ELSE 255 END, '') AS background,
  coalesce('1,2,' || (crop_width + 1) || ',' || (crop_height + 1), '') AS crop, error FROM o"""


def p6_full(spark, sf):
    return _shown(spark, sf, False)


def p12_browser(spark, sf):
    return _shown(spark, sf, True)


QUERIES = {"p6_full": (p6_full, _sql(False)), "p12_browser": (p12_browser, _sql(True))}
