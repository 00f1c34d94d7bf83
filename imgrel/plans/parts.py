"""Queries over the parts of files and bodies, by table functions joined LATERAL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tables
from ..operators import avif
from ..sources.views import duck, view


def _view(spark, sf, name):
    view(spark, sf, name).createOrReplaceTempView(f"parts_{name}")
    tables.register(spark)


def d3_segments(spark, sf):
    _view(spark, sf, "hdr")
    return spark.sql("""
      SELECT h.req_id, s.marker, s.at, s.length FROM (SELECT * FROM parts_hdr WHERE kind = 'jpeg') h, LATERAL jpeg_segments(unhex(h.header)) s""")


D3 = duck("hdr") + """, j AS (SELECT req_id, CASE WHEN req_id % 2 = 0 THEN 6 ELSE 0 END AS more FROM hdr WHERE kind = 'jpeg')
SELECT req_id, 224 AS marker, 2 AS at, 16 AS length FROM j UNION ALL SELECT req_id, 254, 20, 4 FROM j WHERE more > 0
UNION ALL SELECT req_id, 192, 20 + more, 17 FROM j UNION ALL SELECT req_id, 218, 39 + more, NULL FROM j"""


def d4_chunks(spark, sf):
    _view(spark, sf, "hdr")
    return spark.sql("SELECT h.req_id, c.kind, c.at, c.length FROM parts_hdr h, LATERAL webp_chunks(CASE WHEN h.kind = 'webp' THEN unhex(h.header) END) c")


D4 = duck("hdr") + "SELECT req_id, 'VP8X' AS kind, 12 AS at, 10 AS length FROM hdr WHERE kind = 'webp'"


def d5_avif(spark, sf):
    files = view(spark, sf, "avif").select(F.col("req_id").alias("id"), F.unhex("file").alias("content"))
    return avif.headers(files)


D5 = duck("avif") + """SELECT req_id AS id, CASE WHEN shape NOT IN (3, 4, 6, 7) THEN w END AS width, CASE WHEN shape NOT IN (3, 4, 6, 7) THEN h END AS height,
  CASE WHEN shape NOT IN (3, 4, 6, 7) THEN shape IN (1, 2) END AS has_alpha,
  CASE shape WHEN 4 THEN 'avif box payload has trailing bytes' WHEN 6 THEN 'mp4 box exceeds file length'
    WHEN 7 THEN 'mp4 box exceeds file length' END AS error FROM avif"""

_CRLF = "0D0A"
_BODY = f"""SELECT req_id, kind, header, CASE WHEN req_id % 7 = 0 THEN '2D2D78' ELSE '2D2D62' END || '{_CRLF}' ||
  hex('Content-Disposition: form-data; name="file"; filename="' || kind || '"') || '{_CRLF}' || hex('Content-Type: image/' || kind) || '{_CRLF}{_CRLF}' || header
  || '{_CRLF}2D2D62{_CRLF}' || hex('Content-Disposition: form-data; name="options"') || '{_CRLF}{_CRLF}' || hex('{{}}') || '{_CRLF}2D2D622D2D'
  || CASE WHEN req_id % 11 = 0 THEN '21' ELSE '{_CRLF}' END AS body FROM ("""


def s8_parts(spark, sf):
    """Uploads of bytes: files with any byte in them, and their options."""
    tables.register(spark)
    view(spark, sf, "hdr").createOrReplaceTempView("parts_hdr")
    spark.sql(_BODY + "SELECT * FROM parts_hdr) AS h").createOrReplaceTempView("parts_bodies")
    return spark.sql("SELECT b.req_id, p.place, p.name, p.filename, p.content_type, hex(p.content) AS content, p.error FROM parts_bodies b, LATERAL multipart_parts(unhex(b.body), 'b') p")


S8 = duck("hdr") + """, e AS (SELECT *, CASE WHEN req_id % 7 = 0 THEN 'multipart body does not start with the declared boundary'
    WHEN req_id % 11 = 0 THEN 'multipart closing boundary has unexpected trailing data' END AS error FROM hdr)
SELECT req_id, NULL AS place, NULL AS name, NULL AS filename, NULL AS content_type, NULL AS content, error FROM e WHERE error IS NOT NULL
UNION ALL SELECT req_id, 0, 'file', kind, 'image/' || kind, upper(header), NULL FROM e WHERE error IS NULL
UNION ALL SELECT req_id, 1, 'options', NULL, NULL, '7B7D', NULL FROM e WHERE error IS NULL"""

QUERIES = {"d3_segments": (d3_segments, D3), "d4_chunks": (d4_chunks, D4), "d5_avif": (d5_avif, D5), "s8_parts": (s8_parts, S8)}
