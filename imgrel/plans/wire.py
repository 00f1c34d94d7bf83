"""Queries over wire formats: raw requests, uploads, headers, files made from pixels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import http, media
from ..operators import encode, pixels
from ..sources.views import duck, view
from .rasters import _PX

_RAW = """SELECT p_partkey AS req_id, CASE p_partkey % 8
  WHEN 0 THEN 'GET /images/by-path?x=1 HTTP/1.1' || n || 'Host: a.example' || n || n
  WHEN 1 THEN 'POST /images HTTP/1.1' || n || 'Content-Length: 5' || n || 'Host:b' || n || n || 'helloTAIL'
  WHEN 2 THEN 'GET /x' || n || n WHEN 3 THEN 'GET /x HTTP/1.1' || n || 'Host: a' || n || 'HOST: b' || n || n
  WHEN 4 THEN 'POST /x HTTP/1.1' || n || 'Transfer-Encoding: chunked' || n || n WHEN 5 THEN 'POST /x HTTP/1.1' || n || 'Content-Length: -1' || n || n
  WHEN 6 THEN 'GET /x HTTP/1.1' || n || 'nocolon' || n || n ELSE 'POST /x HTTP/1.1' || n || 'Content-Length: ' || CAST(p_partkey AS VARCHAR(20)) || n || n END AS raw
FROM (SELECT p_partkey, chr(13) || chr(10) AS n FROM {part}) AS p"""


def s10_requests(spark, sf):
    raw = spark.sql(_RAW.format(part=f"parquet.`{sf}/part.parquet`"))
    return raw.select("req_id", http.request(F.col("raw"), max_body=1000).alias("r")).select("req_id", "r.method", "r.target", "r.status", "r.error", F.when(F.col("r.status") == 200, F.col("r.body")).alias("body"))


S10 = """SELECT p_partkey AS req_id, CASE WHEN p_partkey % 8 IN (1, 4, 5, 7) THEN 'POST' ELSE 'GET' END AS method,
  CASE p_partkey % 8 WHEN 0 THEN '/images/by-path?x=1' WHEN 1 THEN '/images' ELSE '/x' END AS target,
  (CASE p_partkey % 8 WHEN 0 THEN 200 WHEN 1 THEN 200 WHEN 4 THEN 501 WHEN 7 THEN CASE WHEN p_partkey > 1000 THEN 413 ELSE 400 END ELSE 400 END)::BIGINT AS status,
  CASE p_partkey % 8 WHEN 2 THEN 'request line is missing an HTTP version' WHEN 3 THEN 'duplicate `host` header is not allowed'
    WHEN 4 THEN 'Transfer-Encoding is not supported; use Content-Length instead' WHEN 5 THEN 'content-length must be a non-negative integer'
    WHEN 6 THEN 'request headers must use `name: value` syntax'
    WHEN 7 THEN CASE WHEN p_partkey > 1000 THEN 'request body is too large' ELSE 'request ended before the body was complete' END END AS error,
  CASE p_partkey % 8 WHEN 0 THEN '' WHEN 1 THEN 'hello' END AS body FROM part"""

_UPLOAD = """SELECT p_partkey AS req_id, CASE p_partkey % 6
  WHEN 0 THEN '--B' || n || 'Content-Disposition: form-data; name="file"; filename="a"' || n || 'Content-Type: image/png' || n || n || 'DATA' || n || '--B--' || n
  WHEN 1 THEN '--B' || n || 'Content-Disposition: form-data; name="file"' || n || n || n || '--B--'
  WHEN 2 THEN '--B' || n || 'Content-Disposition: form-data; name="other"' || n || n || 'x' || n || '--B--'
  WHEN 3 THEN 'junk--B--' WHEN 4 THEN '--B' || n || 'Content-Disposition: form-data; name="file"' || n || n || 'x' || n || '--B--trailing'
  ELSE '--B' || n || 'Content-Disposition: form-data; name="file"' || n || n || 'x' || n || '--B' || n || 'Content-Disposition: form-data; name="watermark_margin"' || n || n || '3' || n || '--B--' END AS body
FROM (SELECT p_partkey, chr(13) || chr(10) AS n FROM {part}) AS p"""


def s8_uploads(spark, sf):
    raw = spark.sql(_UPLOAD.format(part=f"parquet.`{sf}/part.parquet`"))
    m = raw.select("req_id", http.multipart(F.col("body"), F.lit("B")).alias("m"))
    return m.select("req_id", F.coalesce("m.error", http.upload_error(F.col("m.parts"))).alias("error"),
                    F.array_join(F.transform("m.parts", lambda p: F.concat_ws("|", p["name"], p["content_type"], p["content"])), ";").alias("parts"))


S8 = """SELECT p_partkey AS req_id, CASE p_partkey % 6 WHEN 1 THEN '`file` must not be empty' WHEN 2 THEN 'unknown multipart field'
    WHEN 3 THEN 'multipart body does not start with the declared boundary' WHEN 4 THEN 'multipart closing boundary has unexpected trailing data'
    WHEN 5 THEN 'watermark fields require `watermark`' END AS error,
  CASE p_partkey % 6 WHEN 0 THEN 'file|image/png|DATA' WHEN 1 THEN 'file|' WHEN 2 THEN 'other|x' WHEN 5 THEN 'file|x;watermark_margin|3' END AS parts FROM part"""


def u4_encodings(spark, sf):
    return view(spark, sf, "texts").groupBy("encodings", http.encodings_allowed(F.col("encodings")).alias("allowed")).agg(F.count(F.lit(1)).alias("n"))


U4 = duck("texts") + "SELECT encodings, encodings IN ('gzip', '', 'identity') AS allowed, count(*) AS n FROM texts GROUP BY ALL"


def v28_headers(spark, sf):
    name = F.element_at(F.array(*map(F.lit, ("X-A", "", "bad name", "Content-Length", "x~y"))), (F.col("req_id") % 5 + 1).cast("int"))
    value = F.when(F.col("req_id") % 7 == 0, "caf\u00e9").otherwise("max-age=1")
    return view(spark, sf, "texts").groupBy(http.header_error(name, value).alias("error")).agg(F.count(F.lit(1)).alias("n"))


V28 = duck("texts") + """SELECT CASE req_id % 5 WHEN 1 THEN 'header name must not be empty' WHEN 2 THEN 'invalid character in header name' WHEN 3 THEN 'framing header'
  ELSE CASE WHEN req_id % 7 = 0 THEN 'invalid character in value' END END AS error, count(*) AS n FROM texts GROUP BY ALL"""


def k3_compressible(spark, sf):
    kind = F.when(F.col("doc_id") % 3 == 0, "text/plain; charset=utf-8").when(F.col("doc_id") % 3 == 1, "application/json").otherwise("image/png")
    return view(spark, sf, "blob").groupBy(http.compressible(kind, F.octet_length("body")).alias("compress")).agg(F.count(F.lit(1)).alias("n"))


K3 = duck("blob") + "SELECT strlen(body) >= 128 AND doc_id % 3 <> 2 AS compress, count(*) AS n FROM blob GROUP BY 1"


def k2_formats(spark, sf):
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return view(spark, sf, "texts").groupBy(F.coalesce(media.parse_media_type(suffix), F.lit("input")).alias("format")).agg(F.count(F.lit(1)).alias("n"))


K2 = duck("texts") + """SELECT coalesce(CASE lower(regexp_extract(path, '\\.([^./]+)$', 1)) WHEN 'jpg' THEN 'jpeg' WHEN 'png' THEN 'png' END, 'input') AS format, count(*) AS n FROM texts GROUP BY 1"""


def p16_errors(spark, sf):
    errors = spark.createDataFrame(media.ERRORS, "kind string, status long, exit_code long, label string")
    kinds = F.element_at(F.array(*(F.lit(e[0]) for e in media.ERRORS)), (F.col("event_id") % 8 + 1).cast("int"))
    log = view(spark, sf, "log").select(kinds.alias("kind"))
    return log.join(F.broadcast(errors), "kind").groupBy("kind", "status", "exit_code", "label").agg(F.count(F.lit(1)).alias("n"))


P16 = duck("log") + ", e AS (FROM (VALUES " + ", ".join(f"({k}, '{e[0]}', {e[1]}, {e[2]}, '{e[3]}')" for k, e in enumerate(media.ERRORS)) + """) AS t(k, kind, status, exit_code, label))
SELECT kind, e.status::BIGINT AS status, exit_code::BIGINT AS exit_code, label, count(*) AS n FROM log JOIN e ON event_id % 8 = k GROUP BY ALL"""


def m3_warnings(spark, sf):
    req = view(spark, sf, "req")
    found = encode.metadata_warnings(F.when(F.col("strip_metadata"), "strip_all").otherwise("keep_all"), F.coalesce("format", "input_type"), F.col("req_id") % 2 == 0, F.col("req_id") % 5 == 0)
    return req.groupBy(F.array_join(found, ",").alias("dropped")).agg(F.count(F.lit(1)).alias("n"))


M3 = duck("req") + """SELECT CASE WHEN strip_metadata THEN '' ELSE concat_ws(',', CASE WHEN req_id % 2 = 0 AND coalesce(format, input_type) NOT IN ('jpeg','png','webp') THEN 'XMP' END,
  CASE WHEN req_id % 5 = 0 AND coalesce(format, input_type) <> 'jpeg' THEN 'IPTC' END) END AS dropped, count(*) AS n FROM req GROUP BY 1"""


def m5_jpeg_xmp(spark, sf):
    jpeg = view(spark, sf, "hdr").where("kind = 'jpeg'")
    return jpeg.select("req_id", F.hex(encode.jpeg_xmp(F.unhex("header"), F.concat(F.lit("<x>"), F.col("req_id").cast("string"), F.lit("</x>")))).alias("content"))


M5 = duck("hdr") + """SELECT req_id, 'FFD8FFE1' || lpad(hex(31 + length('<x>' || req_id || '</x>')), 4, '0') || hex('http://ns.adobe.com/xap/1.0/') || '00' || hex('<x>' || req_id || '</x>') || substr(header, 5) AS content
FROM hdr WHERE kind = 'jpeg'"""


def e12_bmp(spark, sf):
    return encode.bmp(pixels.from_vectors(view(spark, sf, "embeddings"))).select("image_id", F.hex("content").alias("content"))


E12 = _PX + """, r AS (SELECT image_id, y, string_agg(repeat(lpad(hex(v), 2, '0'), 3), '' ORDER BY x) AS line FROM px GROUP BY image_id, y)
SELECT image_id, '424DF6000000' || '00000000' || '36000000' || '28000000' || '08000000' || '08000000' || '01001800' || '00000000' || 'C0000000' || '130B0000130B00000000000000000000'
  || string_agg(line, '' ORDER BY y DESC) AS content FROM r GROUP BY image_id"""


def e9_png(spark, sf):
    """Sizes and colour of each PNG, read back from its own header."""
    made = encode.png(pixels.from_vectors(view(spark, sf, "embeddings")))
    return made.select("image_id", media.header(F.col("content")).alias("h")).select("image_id", "h.media_type", "h.width", "h.height", "h.has_alpha")


E9 = "SELECT vec_id AS image_id, 'png' AS media_type, 8::BIGINT AS width, 8::BIGINT AS height, false AS has_alpha FROM embeddings"

QUERIES = {
    "s8_uploads": (s8_uploads, S8), "s10_requests": (s10_requests, S10), "u4_encodings": (u4_encodings, U4), "v28_headers": (v28_headers, V28), "k2_formats": (k2_formats, K2),
    "k3_compressible": (k3_compressible, K3), "p16_errors": (p16_errors, P16), "m3_warnings": (m3_warnings, M3), "m5_jpeg_xmp": (m5_jpeg_xmp, M5),
    "e9_png": (e9_png, E9), "e12_bmp": (e12_bmp, E12),
}
