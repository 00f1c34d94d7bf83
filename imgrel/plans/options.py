"""Queries over typed parameters, settings, tokens, routes and metadata put into files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import parse, signing
from ..operators import encode, rasters, validate
from ..sources.views import duck, view
from .rasters import _C, H, W, _images, _out

VALUES = ("12", "300", "-1", "+7", "1.5", "1e3", ".5", "abc", "", "true", "TRUE", "false", "0300", "4294967296", "4294967295", " 5", None)
_LIST = "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in VALUES) + "]"


def _value(n):
    return F.element_at(F.array(*map(F.lit, VALUES)), (n % len(VALUES) + 1).cast("int"))


def p10_typed(spark, sf):
    text = _value(F.col("req_id"))
    kinds = {"u32": "width", "u8": "quality", "float": "blur", "bool": "autoOrient"}
    found = {k: parse.typed(text, k, name) for k, name in kinds.items()}
    return view(spark, sf, "texts").select("req_id", *(x["value"].alias(k) for k, x in found.items()), *(x["error"].alias(f"{k}_error") for k, x in found.items()))


P10 = duck("texts") + f""", v AS (SELECT req_id, {_LIST}[req_id % {len(VALUES)} + 1] AS t FROM texts),
n AS (SELECT *, CASE WHEN regexp_full_match(t, '\\+?[0-9]+') THEN try_cast(t AS HUGEINT) END AS i,
  CASE WHEN t NOT SIMILAR TO '.*[\\s].*' THEN try_cast(t AS FLOAT) END AS f FROM v)
SELECT req_id, CASE WHEN i < 4294967296 THEN i::BIGINT END AS u32, CASE WHEN i < 256 THEN i::BIGINT END AS u8, CASE WHEN t NOT IN ('true', 'TRUE', 'false') THEN f::DOUBLE END AS "float",
  CASE t WHEN 'true' THEN true WHEN 'false' THEN false END AS bool,
  CASE WHEN t IS NOT NULL AND NOT coalesce(i < 4294967296, false) THEN 'query parameter `width` must be an integer' END AS u32_error,
  CASE WHEN t IS NOT NULL AND NOT coalesce(i < 256, false) THEN 'query parameter `quality` must be an integer' END AS u8_error,
  CASE WHEN t IS NOT NULL AND (f IS NULL OR t IN ('true', 'TRUE', 'false')) THEN 'query parameter `blur` must be a number' END AS float_error,
  CASE WHEN t NOT IN ('true', 'false') THEN 'query parameter `autoOrient` must be `true` or `false`' END AS bool_error FROM n"""


def v27_settings(spark, sf):
    """A whole number and a decimal one as settings with a range, from many sizes."""
    size = F.col("p_size").cast("string")
    text = F.when(F.col("p_partkey") % 5 == 0, F.concat(size, F.lit(".5"))).when(F.col("p_partkey") % 5 == 1, F.concat(F.lit("-"), size)).when(F.col("p_partkey") % 5 == 2, "").otherwise(size)
    return view(spark, sf, "part").select("p_partkey", parse.setting_error(text, "MAX_CONCURRENT", 2, 40, True).alias("whole"), parse.setting_error(text, "MARGIN", 0.5, 40.25, False).alias("number"))


V27 = """WITH v AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_size + 0.5 WHEN 1 THEN -p_size ELSE p_size END::DOUBLE AS x, p_partkey % 5 = 2 AS none, p_partkey % 5 < 2 AS odd FROM part)
SELECT p_partkey, CASE WHEN none THEN NULL WHEN odd THEN 'MAX_CONCURRENT must be a positive integer' WHEN x < 2 OR x > 40 THEN 'MAX_CONCURRENT must be between 2 and 40' END AS whole,
  CASE WHEN none THEN NULL WHEN x < 0.5 OR x > 40.25 THEN 'MARGIN must be between 0.5 and 40.25' END AS number FROM v"""


def a1_bearer(spark, sf):
    """Tokens that are right for even users, behind schemes in several spellings."""
    token = F.concat(F.lit("t"), (F.col("user_id") % 2).cast("string"))
    scheme = F.element_at(F.array(*map(F.lit, ("Bearer ", "bearer\t ", "Basic ", "Bearer", "", "BEARER  "))), (F.col("event_id") % 6 + 1).cast("int"))
    expected = F.when(F.col("event_id") % 7 > 0, "t0")
    return view(spark, sf, "log").groupBy(signing.bearer_status(F.concat(scheme, token), expected).alias("status")).agg(F.count(F.lit(1)).alias("n"))


A1 = duck("log") + """SELECT (CASE WHEN event_id % 7 = 0 THEN 503 WHEN event_id % 6 IN (0, 1, 5) AND user_id % 2 = 0 THEN 200 ELSE 401 END)::BIGINT AS status, count(*) AS n FROM log GROUP BY 1"""


def t19_routes(spark, sf):
    req = view(spark, sf, "req").withColumn("input_type", F.when(F.col("req_id") % 8 == 3, "svg").otherwise(F.col("input_type")))
    return req.groupBy("input_type", "format", validate.route(req).alias("route")).agg(F.count(F.lit(1)).alias("n"))


T19 = duck("req") + """, r AS (SELECT CASE WHEN req_id % 8 = 3 THEN 'svg' ELSE input_type END AS input_type, format FROM req)
SELECT input_type, format, [['raster', 'UnsupportedOutput'], ['svg', 'svg']][(input_type = 'svg')::INT + 1][coalesce((format = 'svg')::INT, 0) + 1] AS route, count(*) AS n FROM r GROUP BY ALL"""


def m6_png_xmp(spark, sf):
    """XMP put into PNG files: how much longer they are, and that their pixels are still read."""
    files = rasters.encode(_images(spark, sf).withColumn("media_type", F.lit("png")), "media_type")
    xmp = F.concat(F.lit("<x>"), F.col("image_id").cast("string"), F.lit("</x>"))
    made = files.withColumn("content_", encode.png_xmp(F.col("content"), xmp)).withColumn(
        "added", (F.octet_length("content_") - F.octet_length("content")).cast("long")).drop("content").withColumnRenamed("content_", "content")
    return rasters.decode(made).select("image_id", "added", F.hex("data").alias("data"))


M6 = "SELECT image_id, (12 + 17 + 5 + 7 + length(image_id::VARCHAR))::BIGINT AS added, data FROM (" + _C + _out("c", w=str(W), h=str(H)) + ")"

QUERIES = {
    "p10_typed": (p10_typed, P10), "v27_settings": (v27_settings, V27), "a1_bearer": (a1_bearer, A1), "t19_routes": (t19_routes, T19), "m6_png_xmp": (m6_png_xmp, M6),
}
