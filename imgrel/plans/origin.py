"""Queries over remote sources and the caches before them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cache, origin
from ..sources.views import duck, view

_HOST = "https://img.example/p/"


def s6_fetch(spark, sf):
    """Pages as remote images: refused, cached, redirected in several spellings, too large, or fetched."""
    pages, me, then = view(spark, sf, "pages"), F.col("page_id").cast("string"), (F.col("page_id") + 1).cast("string")
    kind = F.col("page_id") % 11
    asked = pages.select(
        F.col("page_id").alias("id"), F.concat(F.when(F.col("page_id") % 13 == 0, "http://10.0.0.1/p/").otherwise(_HOST), me).alias("url"), F.lit(5000).alias("now"))
    cached = pages.where("page_id % 5 = 0").select(
        origin.origin_key("src", F.concat(F.lit(_HOST), me)).alias("key"), (F.col("page_id") * 37 % 5000).alias("mtime"), (F.col("page_id") % 2500).alias("size"))
    location = (
        F.when(kind == 3, F.concat(F.lit("/p/"), then)).when(kind == 4, F.concat(F.lit("../p/./"), then)).when(kind == 5, F.concat(F.lit("//img.example/p/"), then))
        .when(kind == 7, "http://127.0.0.1/x").when(kind.isin(8, 10), then).when(kind == 9, F.concat(F.lit(_HOST), then))
    )
    responses = pages.select(
        F.concat(F.lit(_HOST), me).alias("src"), F.when(kind >= 3, 302).when(kind == 1, 404).otherwise(200).alias("status"), location.alias("location"),
        F.when(kind == 2, "deflate").alias("encoding"), F.lit(None).cast("long").alias("declared"), (F.col("page_id") * 7 % 3000).alias("length"))
    return origin.fetch(asked, cached, responses, max_bytes=2000, ttl=3600, most=2)


S6 = f"""WITH RECURSIVE walk AS (
  SELECT page_id AS id, page_id AS spot, 0 AS hops, NULL::BIGINT AS outcome FROM pages WHERE page_id % 13 <> 0 AND NOT (page_id % 5 = 0 AND 5000 - page_id * 37 % 5000 <= 3600)
  UNION ALL
  SELECT id, CASE WHEN o IS NULL THEN spot + 1 ELSE spot END, CASE WHEN o IS NULL THEN hops + 1 ELSE hops END, o FROM (
    SELECT w.*, CASE WHEN p.page_id IS NULL OR spot % 11 IN (1, 2) THEN 502 WHEN spot % 11 = 0 THEN CASE WHEN spot * 7 % 3000 > 2000 THEN 413 ELSE 200 END
      WHEN hops = 2 THEN 508 WHEN spot % 11 = 6 THEN 502 WHEN spot % 11 = 7 THEN 403 END AS o
    FROM walk w LEFT JOIN pages p ON p.page_id = spot WHERE outcome IS NULL) AS s),
done AS (SELECT * FROM walk WHERE outcome IS NOT NULL)
SELECT page_id AS id, CASE WHEN page_id % 13 = 0 THEN NULL WHEN d.id IS NULL THEN 'hit' ELSE 'miss' END AS origin,
  (CASE WHEN page_id % 13 = 0 THEN 403 WHEN d.id IS NULL THEN CASE WHEN page_id % 2500 > 2000 THEN 413 ELSE 200 END ELSE outcome END)::BIGINT AS outcome,
  CASE WHEN page_id % 13 = 0 THEN 'http://10.0.0.1/p/' || page_id ELSE '{_HOST}' || coalesce(spot, page_id) END AS final, coalesce(hops, 0)::BIGINT AS n_hops,
  (CASE WHEN page_id % 13 = 0 THEN NULL WHEN d.id IS NULL THEN CASE WHEN page_id % 2500 <= 2000 THEN page_id % 2500 END WHEN outcome = 200 THEN spot * 7 % 3000 END)::BIGINT AS length
FROM pages LEFT JOIN done d ON d.id = page_id"""


def u5_body_sizes(spark, sf):
    """Stored objects against a cap of 600 bytes, every third with a declared length of its own."""
    blob, actual = view(spark, sf, "blob"), F.octet_length("body").cast("long")
    declared = F.when(F.col("doc_id") % 3 == 0, F.col("doc_id") % 1200)
    return blob.groupBy(origin.size_error(declared, actual, 600).alias("error")).agg(F.count(F.lit(1)).alias("n"), F.sum(actual).alias("bytes"))


U5 = duck("blob") + """SELECT CASE WHEN (doc_id % 3 = 0 AND doc_id % 1200 > 600) OR strlen(body) > 600 THEN 'remote response exceeds 600 bytes' END AS error,
  count(*) AS n, sum(strlen(body))::BIGINT AS bytes FROM blob GROUP BY 1"""


def c8_origin_keys(spark, sf):
    pages = view(spark, sf, "pages")
    return pages.select("page_id", *(cache.shard(origin.origin_key(n, F.col("url"))).alias(n) for n in ("src", "wm")))


_SHARD = "substr({0}, 1, 2) || '/' || substr({0}, 3, 2) || '/' || substr({0}, 5, 2) || '/' || {0}"
C8 = f"""SELECT page_id, {_SHARD.format('s')} AS src, {_SHARD.format('w')} AS wm FROM (SELECT page_id, sha256('src:' || url) AS s, sha256('wm:' || url) AS w FROM pages)"""


def c9_answers(spark, sf):
    """Cached answers: not modified, whole with their age, or none."""
    blob = view(spark, sf, "blob")
    tag = F.concat(F.lit("sha256-"), F.sha2("body", 256))
    header = F.element_at(F.array(
        F.concat(F.lit('"'), tag, F.lit('"')), F.concat(F.lit('"a", W/"'), tag, F.lit('"')), F.lit('"sha256-0"'), F.lit("*"), F.lit(None).cast("string")),
        (F.col("doc_id") % 5 + 1).cast("int"))
    asked = blob.select("doc_id", "body", F.sha2("object_key", 256).alias("key"), F.lit(5000).cast("long").alias("now"), header.alias("if_none_match"), (F.col("doc_id") % 4 > 0).alias("public"))
    entries = blob.where("doc_id % 3 <> 0").select(F.sha2("object_key", 256).alias("key"), "mtime")
    return origin.answers(cache.lookup(asked, entries, ttl=3600)).select("doc_id", "status", "age_header")


C9A = duck("blob") + """, s AS (SELECT doc_id, doc_id % 3 <> 0 AND 5000 - mtime <= 3600 AS hit, mtime FROM blob)
SELECT doc_id, (CASE WHEN hit THEN CASE WHEN doc_id % 4 > 0 AND doc_id % 5 IN (0, 1, 3) THEN 304 ELSE 200 END END)::BIGINT AS status,
  CASE WHEN hit THEN (5000 - mtime)::VARCHAR END AS age_header FROM s"""


def c7_scans(spark, sf):
    log = view(spark, sf, "log").select((F.col("user_id") % 8).alias("node"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("second"))
    return origin.eviction_scans(log, interval=86400)


C7 = duck("log").replace("WITH ", "WITH RECURSIVE ", 1) + """, w AS (SELECT DISTINCT user_id % 8 AS node, floor(epoch(ts))::BIGINT AS second FROM log),
n AS (SELECT node, second, min(second) OVER (PARTITION BY node ORDER BY second RANGE BETWEEN 86400 FOLLOWING AND UNBOUNDED FOLLOWING) AS following FROM w),
walk AS (SELECT node, min(second) AS second FROM w GROUP BY node UNION ALL SELECT n.node, n.following FROM walk JOIN n USING (node, second) WHERE n.following IS NOT NULL)
SELECT node, second FROM walk"""

QUERIES = {
    "s6_fetch": (s6_fetch, S6), "u5_body_sizes": (u5_body_sizes, U5), "c7_scans": (c7_scans, C7), "c8_origin_keys": (c8_origin_keys, C8), "c9_answers": (c9_answers, C9A),
}
