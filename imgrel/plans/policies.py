"""Queries over rules: IPv6 policy, crops, watermarks, payloads, encoding plans, keys, TIFF headers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry, ipv6, negotiate, parse, tiff
from ..operators import rules
from ..sources.files import inspect
from ..sources.views import duck, view

# Addresses and whether they are denied.
ADDRESSES = [
    ("::1", True), ("::", True), ("ff02::1", True), ("::ffff:127.0.0.1", True), ("::ffff:8.8.8.8", False), ("::10.0.0.1", True),
    ("2002:7f00:1::", True), ("2002:808:808::1", False), ("2001:0:1::", True), ("2001:db8::5", True), ("FD00::1", True),
    ("fe80::1", True), ("2606:4700::1111", False), ("1:2:3", False),
]


def _pick(values, n):
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))


def u3_ipv6(spark, sf):
    picked = view(spark, sf, "log").select(_pick([a for a, _ in ADDRESSES], F.col("event_id")).alias("address"))
    return picked.groupBy("address", ipv6.is_denied(F.col("address")).alias("denied")).agg(F.count(F.lit(1)).alias("n"))


U3 = duck("log") + ", a AS (FROM (VALUES " + ", ".join(f"({k}, '{a}', {str(d).lower()})" for k, (a, d) in enumerate(ADDRESSES)) + f""") AS t(k, address, denied))
SELECT address, denied, count(*) AS n FROM log JOIN a ON event_id % {len(ADDRESSES)} = k GROUP BY ALL"""


def a6_background(spark, sf):
    c = view(spark, sf, "texts").select("req_id", parse.colour(F.col("colour")).alias("c"))
    byte = lambda n: F.lpad(F.hex(F.col(f"c.{n}")), 2, "0")
    text = F.concat(byte("r"), byte("g"), byte("b"), F.when(F.col("c.a") == 255, F.lit("")).otherwise(byte("a")))
    return c.select("req_id", text.alias("background"))


A6 = duck("texts") + """SELECT req_id, CASE WHEN regexp_full_match(colour, '[0-9a-fA-F]{6}|[0-9a-fA-F]{8}')
  THEN CASE WHEN upper(substr(colour, 7)) = 'FF' THEN upper(left(colour, 6)) ELSE upper(colour) END END AS background FROM texts"""


def n2_candidates(spark, sf):
    both = view(spark, sf, "acc").select("req_id", F.posexplode(negotiate.candidates(F.col("input_type"), F.col("has_alpha"))).alias("place", "kind"))
    return both.select("req_id", F.col("place").cast("long").alias("place"), "kind")


N2 = duck("acc") + """SELECT req_id, (generate_subscripts(l, 1) - 1)::BIGINT AS place, unnest(l) AS kind FROM (
  SELECT req_id, CASE WHEN list_contains(b, input_type) THEN b ELSE list_prepend(input_type, b) END AS l
  FROM (SELECT *, CASE WHEN has_alpha THEN ['avif','webp','png','jpeg'] ELSE ['avif','webp','jpeg','png'] END AS b FROM acc))"""


def v23_crop(spark, sf):
    req = view(spark, sf, "req").where("crop_width IS NOT NULL")
    w, h, turned = F.coalesce("width", F.lit(60)), F.coalesce("height", F.lit(50)), F.col("rotate").isin(90, 270)
    error = rules.crop_error(
        F.col("req_id") % 30, F.col("req_id") % 20, F.col("crop_width"), F.col("crop_height"), F.when(turned, h).otherwise(w), F.when(turned, w).otherwise(h))
    return req.select("req_id", error.alias("error"))


V23 = duck("req") + """SELECT req_id, CASE WHEN x + crop_width > iw OR y + crop_height > ih THEN 'crop region ' || crop_width || 'x' || crop_height || '+' || x || '+' || y
  || ' exceeds image bounds ' || iw || 'x' || ih END AS error
FROM (SELECT *, req_id % 30 AS x, req_id % 20 AS y, CASE WHEN rotate IN (90, 270) THEN coalesce(height, 50) ELSE coalesce(width, 60) END AS iw,
  CASE WHEN rotate IN (90, 270) THEN coalesce(width, 60) ELSE coalesce(height, 50) END AS ih FROM req WHERE crop_width IS NOT NULL)"""


def v24_watermark_fits(spark, sf):
    fits = geometry.watermark_fits(
        F.col("w"), F.col("h"), F.coalesce("tw", F.lit(100)), F.coalesce("th", F.lit(100)), F.col("position"), F.col("order_id") % 400)
    return view(spark, sf, "dims").groupBy("position", fits.alias("fits")).agg(F.count(F.lit(1)).alias("n"))


V24 = duck("dims") + """SELECT position, coalesce(tw, 100) + CASE WHEN position IN ('center', 'top', 'bottom') THEN 0 ELSE order_id % 400 END <= w
  AND coalesce(th, 100) + CASE WHEN position IN ('center', 'left', 'right') THEN 0 ELSE order_id % 400 END <= h AS fits, count(*) AS n FROM dims GROUP BY ALL"""


def v29_preference(spark, sf):
    texts = _pick(["avif,webp", "webp, webp", "png,gif,gif", "", "jpg,,jpeg", " tif , bmp"], F.col("req_id"))
    return view(spark, sf, "texts").select(texts.alias("preference")).groupBy("preference", rules.preference_error(F.col("preference")).alias("error")).agg(F.count(F.lit(1)).alias("n"))


V29 = duck("texts") + """SELECT ['avif,webp', 'webp, webp', 'png,gif,gif', '', 'jpg,,jpeg', ' tif , bmp'][req_id % 6 + 1] AS preference,
  [NULL, 'duplicate format `webp`', 'unknown format `gif`', NULL, 'duplicate format `jpeg`', NULL][req_id % 6 + 1] AS error, count(*) AS n FROM texts GROUP BY 1, 2"""


def p6_payload(spark, sf):
    size = F.col("width").cast("string")
    text = F.coalesce(
        F.when(F.col("req_id") % 5 == 0, F.concat(F.lit('{"format":"webp","width":'), F.coalesce(size, F.lit("null")), F.lit("}"))),
        _pick(["{}", '{"autoOrient":false,"quality":80}', '{"width":3,"bogus":1}', '{"width":', '{"stripMetadata":false}'], F.col("req_id")))
    return view(spark, sf, "req").select("req_id", rules.payload(text).alias("p")).select("req_id", "p.options.*", "p.error")


P6 = duck("req") + """SELECT req_id, CASE WHEN req_id % 5 = 0 THEN width END AS width, NULL::BIGINT AS height, CASE WHEN req_id % 5 = 0 THEN 'webp' END AS format,
  (CASE WHEN req_id % 5 = 1 THEN 80 END)::INTEGER AS quality, CASE req_id % 5 WHEN 1 THEN false WHEN 2 THEN NULL WHEN 3 THEN NULL ELSE true END AS auto_orient,
  CASE req_id % 5 WHEN 4 THEN false WHEN 2 THEN NULL WHEN 3 THEN NULL ELSE true END AS strip_metadata,
  CASE req_id % 5 WHEN 2 THEN 'unknown field `bogus`' WHEN 3 THEN 'invalid JSON' END AS error FROM req"""


def e6_plan(spark, sf):
    req = view(spark, sf, "req").withColumn("media", F.coalesce("format", "input_type"))
    return req.select("req_id", rules.encode_plan(F.col("optimize"), F.col("media"), F.col("quality"), F.col("target_value")).alias("p")).select("req_id", "p.*")


E6 = duck("req") + """, r AS (SELECT *, coalesce(format, input_type) AS media FROM req),
g AS (SELECT *, coalesce(target_value, CASE WHEN quality IS NULL THEN CASE media WHEN 'jpeg' THEN 0.985 WHEN 'webp' THEN 0.985 WHEN 'avif' THEN 0.99 END END::DOUBLE) AS goal FROM r),
p AS (SELECT *, CASE optimize WHEN 'none' THEN 'baseline' WHEN 'auto' THEN 'smaller'
  WHEN 'lossless' THEN CASE WHEN media IN ('png', 'webp') THEN 'lossless' WHEN media IN ('jpeg', 'avif') THEN 'CapabilityMissing' ELSE 'InvalidOptions' END
  ELSE CASE WHEN media NOT IN ('jpeg', 'webp', 'avif') THEN 'InvalidOptions' WHEN goal IS NOT NULL THEN 'search' ELSE 'quality' END END AS action FROM g)
SELECT req_id, action, CASE WHEN action = 'search' THEN goal END AS target, CASE WHEN action IN ('search', 'quality') THEN coalesce(quality, 100) END::BIGINT AS max_quality FROM p"""


def j6_keys(spark, sf):
    single = view(spark, sf, "nation").select(F.concat(F.lit("k"), F.col("n_nationkey").cast("string")).alias("key_id"), F.col("n_name").alias("secret"))
    listed = view(spark, sf, "customer").select(
        F.concat(F.lit("k"), F.col("c_custkey").cast("string")).alias("key_id"), F.when(F.col("c_custkey") % 7 == 0, "").otherwise("listed").alias("secret"))
    return rules.signing_keys(single, listed)


J6 = """SELECT coalesce(a.key_id, b.key_id) AS key_id, coalesce(b.secret, a.secret) AS secret
FROM (SELECT 'k' || n_nationkey AS key_id, n_name AS secret FROM nation) a
FULL JOIN (SELECT 'k' || c_custkey AS key_id, 'listed' AS secret FROM customer WHERE c_custkey % 7 <> 0) b ON a.key_id = b.key_id"""


def o5_request_ids(spark, sf):
    header = _pick(["abc-1", "", "a\nb", "a\x00b"], F.col("event_id"))
    return view(spark, sf, "log").groupBy(rules.request_id(header).alias("request_id")).agg(F.count(F.lit(1)).alias("n"))


O5 = duck("log") + "SELECT CASE WHEN event_id % 4 = 0 THEN 'abc-1' END AS request_id, count(*) AS n FROM log GROUP BY 1"

_TIFF = """SELECT req_id, w, h, alpha, CASE WHEN req_id % 2 = 0
  THEN '4D4D002A00000008' || '0004' || '0100000400000001' || lpad(hex(w), 8, '0') || '0101000400000001' || lpad(hex(h), 8, '0')
    || '010600030000000100020000' || '0115000300000001' || CASE WHEN alpha THEN '0004' ELSE '0003' END || '0000' || '00000000'
  ELSE '49492A0008000000' || '0400' || '0001030001000000' || substr(lpad(hex(w), 4, '0'), 3, 2) || substr(lpad(hex(w), 4, '0'), 1, 2) || '0000'
    || '0101030001000000' || substr(lpad(hex(h), 4, '0'), 3, 2) || substr(lpad(hex(h), 4, '0'), 1, 2) || '0000'
    || '060103000100000002000000' || '1501030001000000' || CASE WHEN alpha THEN '0400' ELSE '0300' END || '0000' || '00000000' END AS file FROM hdr"""


def d7_tiff(spark, sf):
    return spark.sql(_TIFF.replace("FROM hdr", "FROM {hdr}"), hdr=view(spark, sf, "hdr")).select("req_id", tiff.header(F.unhex("file")).alias("h")).select("req_id", "h.*")


D7 = duck("hdr") + "SELECT req_id, w AS width, h AS height, alpha AS has_alpha FROM hdr"


def k5_inspection(spark, sf):
    files = view(spark, sf, "hdr").select(F.concat(F.lit("/in/"), F.col("req_id").cast("string")).alias("path"), F.unhex("header").alias("content"))
    return inspect(files)


K5 = duck("hdr") + """SELECT '/in/' || req_id AS path, CASE WHEN kind <> 'gif' THEN '{"format":"' || kind || '","mime":"image/' || kind || CASE kind WHEN 'svg' THEN '+xml' ELSE '' END
  || '","width":' || CASE kind WHEN 'svg' THEN 'null' ELSE w::VARCHAR END || ',"height":' || CASE kind WHEN 'svg' THEN 'null' ELSE h::VARCHAR END
  || ',"hasAlpha":' || CASE kind WHEN 'svg' THEN 'true' WHEN 'jpeg' THEN 'false' ELSE alpha::VARCHAR END || ',"isAnimated":false}' END AS body FROM hdr"""

QUERIES = {
    "u3_ipv6": (u3_ipv6, U3), "a6_background": (a6_background, A6), "n2_candidates": (n2_candidates, N2), "v23_crop": (v23_crop, V23),
    "v24_watermark_fits": (v24_watermark_fits, V24), "v29_preference": (v29_preference, V29), "p6_payload": (p6_payload, P6), "e6_plan": (e6_plan, E6),
    "j6_keys": (j6_keys, J6), "o5_request_ids": (o5_request_ids, O5), "d7_tiff": (d7_tiff, D7), "k5_inspection": (k5_inspection, K5),
}
