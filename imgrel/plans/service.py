"""Queries over the service's side: negotiation, signing, URL policy, caching, limits, metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import media, negotiate, signing, svg, urls
from ..operators import cache, limits, metrics
from ..sources.views import duck, view


def n1_accept(spark, sf):
    parsed = view(spark, sf, "acc").select("req_id", F.posexplode(negotiate.preferences(F.col("accept"))).alias("place", "p"))
    return parsed.select("req_id", F.col("place").cast("long").alias("place"), F.col("p.range").alias("media_range"), F.col("p.q").alias("q"),
                         F.col("p.specificity").cast("long").alias("specificity"))


_PREFS = """, seg AS (SELECT req_id, trim(s) AS s, i FROM (SELECT req_id, unnest(string_split(accept, ',')) AS s, generate_subscripts(string_split(accept, ','), 1) AS i FROM acc) WHERE trim(s) <> ''),
pref AS (SELECT req_id, i, lower(trim(split_part(s, ';', 1))) AS media_range, regexp_extract(s, '(?i);\\s*q\\s*=\\s*([^;]*)', 1) AS raw FROM seg),
good AS (SELECT req_id, i, media_range, CASE WHEN raw = '' THEN 1000 ELSE round(try_cast(raw AS DOUBLE) * 1000)::BIGINT END AS q,
  CASE media_range WHEN '*/*' THEN 0 WHEN 'image/*' THEN 1 ELSE 2 END AS specificity FROM pref
  WHERE media_range IN ('*/*','image/*','image/jpeg','image/png','image/webp','image/avif','image/bmp','image/svg+xml')
    AND (raw = '' OR try_cast(raw AS DOUBLE) BETWEEN 0 AND 1))"""
N1 = duck("acc") + _PREFS + """ SELECT req_id, row_number() OVER (PARTITION BY req_id ORDER BY i) - 1 AS place, media_range, q::BIGINT AS q, specificity::BIGINT AS specificity FROM good"""


def n4_negotiate(spark, sf):
    return negotiate.negotiate(view(spark, sf, "acc").select("req_id", "accept", "input_type", "has_alpha")).select("req_id", "chosen", "status")


N4 = duck("acc") + _PREFS + """, cand AS (
  SELECT req_id, accept, unnest(l) AS kind, generate_subscripts(l, 1) AS place FROM (SELECT req_id, accept, CASE WHEN list_contains(b, input_type) THEN b ELSE list_prepend(input_type, b) END AS l
    FROM (SELECT *, CASE WHEN has_alpha THEN ['avif','webp','png','jpeg'] ELSE ['avif','webp','jpeg','png'] END AS b FROM acc))),
best AS (SELECT c.req_id, kind, place, coalesce(max(g.q * 10 + g.specificity), 0) AS score FROM cand c LEFT JOIN good g ON g.req_id = c.req_id
    AND (g.media_range IN ('*/*', 'image/*') OR g.media_range = CASE kind WHEN 'svg' THEN 'image/svg+xml' ELSE 'image/' || kind END) GROUP BY ALL),
top AS (SELECT req_id, arg_max(kind, score * 100 - place) AS kind, max(score) AS score FROM best GROUP BY req_id)
SELECT req_id, CASE WHEN score >= 10 AND trim(coalesce(accept, ''), ' ,') <> '' THEN kind END AS chosen,
  (CASE WHEN score >= 10 OR trim(coalesce(accept, ''), ' ,') = '' THEN 200 ELSE 406 END)::BIGINT AS status FROM top JOIN acc USING (req_id)"""


def n5_etags(spark, sf):
    return view(spark, sf, "blob").groupBy(negotiate.etag(F.col("body")).alias("etag")).agg(F.count(F.lit(1)).alias("n"))


N5 = duck("blob") + """SELECT '"sha256-' || sha256(body) || '"' AS etag, count(*) AS n FROM blob GROUP BY 1"""


def n6_not_modified(spark, sf):
    tag = F.concat(F.lit('"sha256-'), F.col("req_id").cast("string"), F.lit('"'))
    return view(spark, sf, "acc").select("req_id", negotiate.not_modified(F.col("if_none_match"), tag).alias("not_modified"))


N6 = duck("acc") + "SELECT req_id, if_none_match IS NOT NULL AS not_modified FROM acc"


def n7_headers(spark, sf):
    b = view(spark, sf, "blob")
    kind = F.when(F.col("doc_id") % 3 == 0, "svg").otherwise("png")
    h = negotiate.response_headers(kind, negotiate.etag(F.col("body")), F.col("doc_id") % 2 == 0, F.col("doc_id") % 4 == 0, F.col("doc_id") % 5 == 0)
    return b.select("doc_id", F.array_join(F.transform(F.array_sort(F.map_entries(h)), lambda e: F.concat_ws(": ", e["key"], e["value"])), "\n").alias("headers"))


N7 = duck("blob") + """SELECT doc_id, 'Cache-Control: ' || CASE WHEN doc_id % 2 = 0 THEN 'public, max-age=3600, stale-while-revalidate=60' ELSE 'no-store' END || chr(10)
  || 'Cache-Status: "imgrel"; ' || CASE WHEN doc_id % 5 = 0 THEN 'hit' ELSE 'fwd=miss' END || chr(10)
  || 'Content-Disposition: inline; filename="imgrel.' || CASE WHEN doc_id % 3 = 0 THEN 'svg' ELSE 'png' END || '"' || chr(10)
  || CASE WHEN doc_id % 3 = 0 THEN 'Content-Security-Policy: sandbox' || chr(10) ELSE '' END || 'ETag: "sha256-' || sha256(body) || '"'
  || CASE WHEN doc_id % 4 = 0 THEN chr(10) || 'Vary: Accept' ELSE '' END || chr(10) || 'X-Content-Type-Options: nosniff' AS headers FROM blob"""


def _signed(spark, sf):
    req = view(spark, sf, "req")
    entries = F.array(
        F.struct(F.lit("path").alias("key"), F.concat(F.lit("/"), F.col("source_path"), F.lit("é~*.jpg")).alias("value")),
        F.struct(F.lit("width").alias("key"), F.col("width").cast("string").alias("value")),
        F.struct(F.lit("format").alias("key"), F.col("format").alias("value")),
        F.struct(F.lit("keyId").alias("key"), F.when(F.col("req_id") % 10 == 0, "none").otherwise("k1").alias("value")),
        F.struct(F.lit("expires").alias("key"), F.when(F.col("req_id") % 15 == 1, F.lit("soon")).otherwise((F.col("req_id") + 1000).cast("string")).alias("value")),
    )
    query = F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))
    return req.select("req_id", F.lit("GET").alias("method"), F.lit("cdn.example.com").alias("authority"), F.lit("/images/by-path").alias("path"), query.alias("query"))


_QUERY_SQL = """'expires=' || expires || coalesce('&format=' || format, '') || '&keyId=' || key || '&path=%2F' || replace(source_path, ' ', '+') || '%C3%A9%7E*.jpg' || coalesce('&width=' || width, '')"""
_SIGNED_SQL = duck("req") + f""", s AS (SELECT *, CASE WHEN req_id % 10 = 0 THEN 'none' ELSE 'k1' END AS key, CASE WHEN req_id % 15 = 1 THEN 'soon' ELSE (req_id + 1000)::VARCHAR END AS expires FROM req),
q AS (SELECT *, {_QUERY_SQL} AS canonical FROM s)"""


def a2_canonical(spark, sf):
    return _signed(spark, sf).select("req_id", signing.canonical_query(F.col("query")).alias("canonical"))


A2 = _SIGNED_SQL + " SELECT req_id, canonical FROM q"


def a3_sign(spark, sf):
    text = signing.canonical(*(F.col(c) for c in ("method", "authority", "path", "query")))
    return _signed(spark, sf).select("req_id", signing.hmac_sha256(F.lit("a secret"), text).alias("signature"))


_IPAD = "".join(f"{(b ^ 0x36):02x}" for b in b"a secret".ljust(64, b"\0"))
_OPAD = "".join(f"{(b ^ 0x5C):02x}" for b in b"a secret".ljust(64, b"\0"))
A3 = _SIGNED_SQL + f""" SELECT req_id, sha256(unhex('{_OPAD}' || sha256(unhex('{_IPAD}' || hex('GET' || chr(10) || 'cdn.example.com' || chr(10)
  || '/images/by-path' || chr(10) || canonical))))) AS signature FROM q"""


def a4_verify(spark, sf):
    requests = _signed(spark, sf)
    text = signing.canonical(*(F.col(c) for c in ("method", "authority", "path", "query")))
    good = signing.hmac_sha256(F.lit("a secret"), text)
    sent = F.when(F.col("req_id") % 12 == 5, F.concat(F.substring(good, 1, 63), F.lit("x"))).otherwise(good)
    requests = requests.withColumn("query", F.map_concat("query", F.create_map(F.lit("signature"), sent)))
    keys = spark.createDataFrame([("k1", "a secret"), ("k2", "another")], "key_id string, secret string")
    return signing.verify(requests, keys, now=1500).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


A4 = _SIGNED_SQL + """ SELECT (CASE WHEN key = 'none' THEN 401 WHEN expires = 'soon' THEN 400 WHEN try_cast(expires AS BIGINT) < 1500 THEN 401
  WHEN req_id % 12 = 5 THEN 401 ELSE 200 END)::BIGINT AS status, count(*) AS n FROM q GROUP BY 1"""


def a5_names(spark, sf):
    names = F.transform(F.split("query", "&"), lambda s: F.substring_index(s, "=", 1))
    unknown = F.array_except(F.filter(names, lambda s: s != ""), F.array(*map(F.lit, signing.ALLOWED)))
    return view(spark, sf, "texts").groupBy(F.array_join(F.array_sort(unknown), ",").alias("unknown")).agg(F.count(F.lit(1)).alias("n"))


A5 = duck("texts") + """SELECT CASE req_id % 6 WHEN 0 THEN '' WHEN 1 THEN '' WHEN 2 THEN 'bogus' WHEN 3 THEN 'a,b' WHEN 4 THEN (CASE WHEN query = '' THEN '' ELSE 'name' END) ELSE 'name' END AS unknown, count(*) AS n FROM texts GROUP BY 1"""


def a7_expiry(spark, sf):
    now = F.unix_seconds(F.col("ts").cast("timestamp"))
    return view(spark, sf, "log").groupBy(signing.stable_expiry(now, 3600).alias("expires")).agg(F.count(F.lit(1)).alias("n"))


A7 = duck("log") + "SELECT (ceil(floor(epoch(ts)) / 3600) * 3600)::BIGINT AS expires, count(*) AS n FROM log GROUP BY 1"


def u1_urls(spark, sf):
    return view(spark, sf, "urls").select("page_id", urls.url_status(F.col("url")).alias("status"))


# the ranges again, as numbers
_RANGES = [(0, 0), (167772160, 184549375), (1681915904, 1686110207), (2130706432, 2147483647), (2851995648, 2852061183), (2886729728, 2887778303),
           (3221225984, 3221226239), (3232235520, 3232301055), (3323068416, 3323199487), (3325256704, 3325256959), (3405803776, 3405804031), (3758096384, 4294967295)]
U1 = duck("urls") + f"""SELECT page_id, (CASE WHEN page_id % 13 IN (7, 8, 11) THEN 400 WHEN page_id % 13 IN (9, 10) THEN 403 WHEN page_id % 13 = 12 THEN 200
  WHEN {' OR '.join(f'n BETWEEN {low} AND {high}' for low, high in _RANGES)} THEN 403 ELSE 200 END)::BIGINT AS status FROM urls"""


def u2_denied(spark, sf):
    octet = lambda c: (c % 256).cast("string")
    ip = F.concat_ws(".", octet(F.col("l_orderkey")), octet(F.col("l_partkey")), octet(F.col("l_suppkey")), octet(F.col("l_linenumber")))
    return view(spark, sf, "lineitem").select(ip.alias("ip")).groupBy(F.substring_index("ip", ".", 1).alias("first")).agg(
        F.count_if(urls.is_denied(F.col("ip"))).alias("denied"), F.count(F.lit(1)).alias("n"))


U2 = """WITH v AS (SELECT l_orderkey % 256 AS a, l_partkey % 256 AS b, l_suppkey % 256 AS c, l_linenumber % 256 AS d FROM lineitem)
SELECT a::VARCHAR AS first, count(*) FILTER (a IN (10, 127) OR a >= 224 OR (a = 100 AND b BETWEEN 64 AND 127) OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31)
  OR (a = 192 AND b = 168) OR (a = 192 AND b = 0 AND c = 2) OR (a = 198 AND b IN (18, 19)) OR (a = 198 AND b = 51 AND c = 100) OR (a = 203 AND b = 0 AND c = 113)
  OR (a = 0 AND b = 0 AND c = 0 AND d = 0)) AS denied, count(*) AS n FROM v GROUP BY 1"""


def u7_client(spark, sf):
    ip = urls.client_address(F.col("peer"), F.col("xff"), F.col("real_ip"), [("10.0.0.0", 8)])
    return view(spark, sf, "xff").select("req_id", ip.alias("client"))


U7 = duck("xff") + """, h AS (SELECT *, list_filter(list_transform(string_split(xff, ','), lambda x: trim(x)), lambda x: regexp_full_match(x, '[0-9.]+') AND NOT starts_with(x, '10.')) AS l FROM xff)
SELECT req_id, CASE WHEN starts_with(peer, '10.') THEN coalesce(l[-1], real_ip, peer) ELSE peer END AS client FROM h"""


def s5_object_urls(spark, sf):
    scheme = F.when(F.col("doc_id") % 3 == 0, "s3a").when(F.col("doc_id") % 3 == 1, "gs").otherwise("abfss")
    bucket = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("b"), (F.col("doc_id") % 10).cast("string")))
    return view(spark, sf, "blob").select("doc_id", urls.object_url(scheme, bucket, "images", F.col("object_key")).alias("url"))


S5 = duck("blob") + """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 's3a' WHEN 1 THEN 'gs' ELSE 'abfss' END || '://' ||
  coalesce(CASE WHEN doc_id % 2 = 0 THEN 'b' || (doc_id % 10) END, 'images') || '/' || object_key AS url FROM blob"""


def s7_redirects(spark, sf):
    pages = view(spark, sf, "pages").select("page_id")
    start = pages.select(F.col("page_id").alias("id"), F.concat(F.lit("/p/"), F.col("page_id").cast("string")).alias("url"))
    target = F.when(F.col("page_id") % 11 == 7, None).otherwise(F.concat(F.lit("/p/"), (F.col("page_id") + 1).cast("string")))
    hops = pages.where("page_id % 11 >= 2").select(F.concat(F.lit("/p/"), F.col("page_id").cast("string")).alias("src"),
                                                   F.when(F.col("page_id") % 2 == 0, 301).otherwise(302).alias("status"), target.alias("location"))
    return urls.follow_redirects(start, hops)


S7 = """WITH RECURSIVE hops AS (SELECT '/p/' || page_id AS src, CASE WHEN page_id % 11 <> 7 THEN '/p/' || (page_id + 1) END AS location FROM pages WHERE page_id % 11 >= 2),
walk AS (SELECT page_id AS id, '/p/' || page_id AS url, 0 AS n_hops, NULL::BIGINT AS status FROM pages
  UNION ALL
  SELECT id, CASE WHEN src IS NOT NULL AND location IS NOT NULL AND n_hops < 5 THEN location ELSE url END,
    CASE WHEN src IS NOT NULL AND location IS NOT NULL AND n_hops < 5 THEN n_hops + 1 ELSE n_hops END,
    CASE WHEN src IS NULL THEN 200 WHEN location IS NULL THEN 502 WHEN n_hops = 5 THEN 508 END
  FROM walk LEFT JOIN hops ON src = url WHERE status IS NULL)
SELECT id, url, n_hops::BIGINT AS n_hops, status FROM walk WHERE status IS NOT NULL"""


def c2_watermark_identity(spark, sf):
    position = F.coalesce("position", F.lit("bottom-right"))
    return view(spark, sf, "req").select("req_id", cache.watermark_identity(
        F.concat(F.lit("https://example.com/"), F.col("source_path")), position, F.col("req_id") % 100 + 1, F.col("req_id") % 20).alias("identity"))


C2 = duck("req") + """SELECT req_id, sha256('watermark' || chr(10) || 'https://example.com/' || source_path || chr(10) || coalesce(position, 'bottom-right') || chr(10)
  || (req_id % 100 + 1) || chr(10) || (req_id % 20)) AS identity FROM req"""


def c3_version_hash(spark, sf):
    return view(spark, sf, "blob").select("doc_id", cache.version_hash(F.lit("path"), F.col("object_key"), F.col("version"), "/data").alias("hash"))


C3 = duck("blob") + """SELECT doc_id, sha256('path' || chr(10) || object_key || chr(10) || version || chr(10) || '/data' || chr(10) || 'strict' || chr(10) || 'filesystem') AS hash FROM blob"""


def c4_lookup(spark, sf):
    blob = view(spark, sf, "blob")
    entries = blob.where("doc_id % 3 <> 0").select(F.sha2("object_key", 256).alias("key"), "mtime")
    asked = blob.select("doc_id", F.sha2("object_key", 256).alias("key"), F.lit(5000).cast("long").alias("now"))
    return cache.lookup(asked, entries, ttl=3600).groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.sum("age").alias("age"))


C4 = duck("blob") + """SELECT CASE WHEN doc_id % 3 = 0 THEN 'miss' WHEN 5000 - mtime <= 3600 THEN 'hit' ELSE 'stale' END AS state, count(*) AS n,
  sum(CASE WHEN doc_id % 3 <> 0 AND 5000 - mtime <= 3600 THEN 5000 - mtime END)::BIGINT AS age FROM blob GROUP BY 1"""


def c5_shards(spark, sf):
    return view(spark, sf, "blob").select("doc_id", cache.shard(F.sha2("object_key", 256)).alias("path"))


C5 = duck("blob") + """, k AS (SELECT doc_id, sha256(object_key) AS k FROM blob)
SELECT doc_id, substr(k, 1, 2) || '/' || substr(k, 3, 2) || '/' || substr(k, 5, 2) || '/' || k AS path FROM k"""


def c6_evict(spark, sf):
    entries = view(spark, sf, "blob").select(F.col("object_key").alias("key"), "size", "mtime")
    return cache.evict(entries, max_bytes=1_000_000)


C6 = duck("blob") + """, r AS (SELECT object_key AS key, size, mtime, coalesce(sum(size) OVER (ORDER BY mtime, object_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  sum(size) OVER () AS total FROM blob)
SELECT key, size, mtime, total - before > 1000000 AS evicted FROM r"""


def c9_two_stage(spark, sf):
    """Cached answers first; only for the rest are the bodies read."""
    blob = view(spark, sf, "blob")
    cached = blob.where("doc_id % 3 <> 0").select(F.col("object_key").alias("hit_key"))
    misses = blob.join(cached, blob["object_key"] == cached["hit_key"], "left_anti")
    return misses.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("body").cast("long")).alias("bytes_read"))


C9 = duck("blob") + "SELECT source, count(*) AS n, sum(strlen(body))::BIGINT AS bytes_read FROM blob WHERE doc_id % 3 = 0 GROUP BY source"


def r1_token_bucket(spark, sf):
    events = view(spark, sf, "log").select(F.col("user_id").alias("key"), "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("at"))
    return limits.token_bucket(events, rate=0.0001, burst=2.0).groupBy("key").agg(
        F.count_if("admitted").alias("admitted"), F.count(F.lit(1)).alias("n"))


R1 = duck("log").replace("WITH", "WITH RECURSIVE", 1) + """, e AS (SELECT user_id AS key, epoch_us(ts) / 1000000.0::DOUBLE AS at_s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM log),
w AS (
  SELECT key, i, at_s, 1.0::DOUBLE AS tokens, true AS ok FROM e WHERE i = 1
  UNION ALL
  SELECT f.key, f.i, f.at_s, least(2.0, s.tokens + (f.at_s - s.at_s) * 0.0001) - CASE WHEN least(2.0, s.tokens + (f.at_s - s.at_s) * 0.0001) >= 1 THEN 1 ELSE 0 END,
    least(2.0, s.tokens + (f.at_s - s.at_s) * 0.0001) >= 1 FROM w s JOIN e f ON f.key = s.key AND f.i = s.i + 1)
SELECT key, count(*) FILTER (ok) AS admitted, count(*) AS n FROM w GROUP BY key"""


def r4_in_flight(spark, sf):
    t = F.unix_seconds(F.col("ts").cast("timestamp"))
    events = view(spark, sf, "log").select((F.col("user_id") % 8).alias("server"), "event_id", t.alias("start"), (t + F.floor(F.col("latency_s") * 200).cast("long") + 1).alias("end"))
    return limits.in_flight(events).groupBy("server").agg(F.count_if(F.col("running") >= 3).alias("refused"), F.max("running").alias("most"), F.count(F.lit(1)).alias("n"))


R4 = duck("log") + """, e AS (SELECT user_id % 8 AS server, event_id, floor(epoch(ts))::BIGINT AS s, floor(epoch(ts))::BIGINT + floor(latency_s * 200)::BIGINT + 1 AS e FROM log),
r AS (SELECT a.server, a.event_id, count(b.event_id) AS running FROM e a LEFT JOIN e b ON a.server = b.server AND b.e > a.s AND (b.s < a.s OR (b.s = a.s AND b.event_id < a.event_id)) GROUP BY 1, 2)
SELECT server, count(*) FILTER (running >= 3) AS refused, max(running) AS most, count(*) AS n FROM r GROUP BY server"""


def h1_hysteresis(spark, sf):
    samples = view(spark, sf, "log").select((F.col("user_id") % 5).alias("probe"), F.col("event_id").alias("at"), F.floor(F.col("latency_s") * 40).cast("long").alias("value"))
    return limits.hysteresis(samples, threshold=900, margin=0.1)


H1 = duck("log").replace("WITH", "WITH RECURSIVE", 1) + """, e AS (SELECT user_id % 5 AS probe, event_id AS "at", floor(latency_s * 40)::BIGINT AS value, row_number() OVER (PARTITION BY user_id % 5 ORDER BY event_id) AS i FROM log),
w AS (SELECT probe, "at", value, i, value < 900 AS ok FROM e WHERE i = 1
  UNION ALL SELECT e.probe, e."at", e.value, e.i, CASE WHEN s.ok THEN e.value < 900 ELSE e.value < 810 END FROM w s JOIN e ON e.probe = s.probe AND e.i = s.i + 1)
SELECT probe, "at", value, ok, NOT ok AND value < 900 AS recovering FROM w"""


def h2_readiness(spark, sf):
    checks = view(spark, sf, "log").select("user_id", F.concat(F.lit("check"), (F.col("event_id") % 3).cast("string")).alias("name"), (F.col("latency_s") < 20).alias("ok"))
    return limits.readiness(checks, "user_id")


H2 = duck("log") + """SELECT user_id, bool_and(latency_s < 20) AS ready, count(*) AS n_checks,
  coalesce(string_agg(DISTINCT CASE WHEN NOT latency_s < 20 THEN 'check' || (event_id % 3) END, ',' ORDER BY CASE WHEN NOT latency_s < 20 THEN 'check' || (event_id % 3) END), '') AS failed FROM log GROUP BY user_id"""

_ROUTE = """CASE WHEN method IN ('GET', 'HEAD') AND path = '/images/by-path' THEN 'public_by_path' WHEN method IN ('GET', 'HEAD') AND path = '/images/by-url' THEN 'public_by_url'
  WHEN method = 'POST' AND path = '/images:transform' THEN 'transform' WHEN method = 'POST' AND path = '/images' THEN 'upload'
  WHEN method IN ('GET', 'HEAD') AND path = '/metrics' THEN 'metrics' ELSE 'unknown' END"""


def o1_counters(spark, sf):
    labels = [label for *_, label in metrics.ROUTES] + ["unknown"]
    return metrics.counts_by(view(spark, sf, "log"), metrics.route(F.col("method"), F.col("path")), labels)


O1 = duck("log") + f""", d AS (SELECT unnest(['health','health_live','health_ready','public_by_path','public_by_url','transform','upload','metrics','unknown']) AS label),
c AS (SELECT {_ROUTE} AS label, count(*) AS n FROM log GROUP BY 1) SELECT label, coalesce(n, 0)::BIGINT AS n FROM d LEFT JOIN c USING (label)"""


def o2_histogram(spark, sf):
    return metrics.histogram(view(spark, sf, "log"), "format", "latency_s")


_LE = "(FROM (VALUES " + ", ".join(f"('{float(b)}', {float(b)}::DOUBLE)" for b in metrics.BOUNDS) + ", ('+Inf', 'inf'::DOUBLE)) AS t(le, bound))"
O2 = duck("log") + f""", b AS {_LE} SELECT format, le, count(*) FILTER (latency_s <= bound) AS n FROM log, b GROUP BY format, le"""


def o3_statuses(spark, sf):
    return metrics.counts_by(view(spark, sf, "log"), metrics.status_label(F.col("status")), [*metrics.STATUSES, "other"])


O3 = duck("log") + """, d AS (SELECT unnest(['200','304','400','401','403','404','406','413','415','500','501','502','503','508','other']) AS label),
c AS (SELECT CASE WHEN status IN ('422', '429') THEN 'other' ELSE status END AS label, count(*) AS n FROM log GROUP BY 1) SELECT label, coalesce(n, 0)::BIGINT AS n FROM d LEFT JOIN c USING (label)"""


def o4_rate(spark, sf):
    return metrics.rate(view(spark, sf, "log"))


O4 = duck("log") + f"""SELECT (floor(epoch(ts))::BIGINT // 300) * 300 AS window_start, {_ROUTE} AS route, count(*) AS n, count(*) FILTER (status >= '500') AS errors FROM log GROUP BY 1, 2"""


def o4_hit_ratio(spark, sf):
    return metrics.hit_ratio(view(spark, sf, "log"))


O4B = duck("log") + """SELECT format, count(*) FILTER (cache_status = 'hit') AS hits, count(*) AS lookups, round(avg((cache_status = 'hit')::INT), 6) AS ratio
FROM log WHERE cache_status IS NOT NULL GROUP BY format"""


def o4_quantile(spark, sf):
    return metrics.quantile(view(spark, sf, "log"), "format", "latency_s", 0.95)


O4C = duck("log") + f""", b AS {_LE}, h AS (SELECT format, bound, count(*) FILTER (latency_s <= bound) AS n FROM log, b GROUP BY ALL),
s AS (SELECT *, coalesce(lag(bound) OVER w, 0) AS low, coalesce(lag(n) OVER w, 0) AS under, max(n) OVER (PARTITION BY format) AS total FROM h WINDOW w AS (PARTITION BY format ORDER BY bound)),
f AS (SELECT DISTINCT ON (format) * FROM s WHERE n >= total * 0.95::DOUBLE ORDER BY format, bound)
SELECT format, round(CASE WHEN isinf(bound) THEN low WHEN n = under THEN bound ELSE low + (bound - low) * (total * 0.95::DOUBLE - under) / (n - under) END, 6) AS quantile FROM f"""


def k4_problems(spark, sf):
    log = view(spark, sf, "log").where("status >= '400'")
    return log.select("event_id", metrics.problem(F.col("status").cast("int"), F.concat(F.lit("Status "), F.col("status")), F.col("path")).alias("body"))


K4 = duck("log") + """SELECT event_id, '{"type":"about:blank","title":"Status ' || status || '","status":' || status || ',"detail":"' || path || '"}' AS body FROM log WHERE status >= '400'"""


def k6_access_log(spark, sf):
    line = F.to_json(F.struct(F.lit("access_log").alias("kind"), F.col("event_id").cast("string").alias("request_id"), "method", "path",
                              metrics.route(F.col("method"), F.col("path")).alias("route"), "status", F.floor(F.col("latency_s") * 1000).cast("long").alias("latency_ms"), "cache_status"))
    return view(spark, sf, "log").select("event_id", line.alias("line"))


K6 = duck("log") + f"""SELECT event_id, '{{"kind":"access_log","request_id":"' || event_id || '","method":"' || method || '","path":"' || path || '","route":"' || {_ROUTE} || '","status":"' || status
  || '","latency_ms":' || floor(latency_s * 1000)::BIGINT || coalesce(',"cache_status":"' || cache_status || '"', '') || '}}' AS line FROM log"""


def k7_exposition(spark, sf):
    return metrics.exposition(metrics.histogram(view(spark, sf, "log"), "format", "latency_s"), "format", "imgrel_transform_seconds")


K7 = duck("log") + f""", b AS {_LE}, h AS (SELECT format, le, bound, count(*) FILTER (latency_s <= bound) AS n FROM log, b GROUP BY ALL)
SELECT format, string_agg('imgrel_transform_seconds_bucket{{format="' || format || '",le="' || CASE WHEN le LIKE '%.0' THEN split_part(le, '.', 1) ELSE le END || '"}} ' || n, chr(10) ORDER BY bound) AS body FROM h GROUP BY format"""

_SVG = """SELECT page_id, '<svg xmlns="http://www.w3.org/2000/svg"><style>@import url(x.css); a{fill:url(' || CASE page_id % 3 WHEN 0 THEN '#g' WHEN 1 THEN 'http://e.com/a.png' ELSE 'data:image/png;base64,AA' END || ')}</style>'
  || CASE WHEN page_id % 2 = 0 THEN '<script>alert(1)</script>' ELSE '<foreignObject width="1"><b/></foreignObject>' END || '<rect onclick="x()" width="' || page_id || '"/>'
  || '<a xlink:href="' || CASE page_id % 4 WHEN 0 THEN '#ok' WHEN 1 THEN 'javascript:x' WHEN 2 THEN 'data:image/svg+xml,x' ELSE 'data:image/gif;x' END || '">t</a></svg>' AS svg FROM """


def g2_sanitize(spark, sf):
    made = spark.sql(_SVG + f"parquet.`{sf}/pages.parquet`")
    return made.select("page_id", svg.sanitize(F.encode("svg", "UTF-8"))["clean"].alias("clean"), media.is_svg(F.col("svg")).alias("is_svg"))


G2 = """SELECT page_id, '<svg xmlns="http://www.w3.org/2000/svg"><style> a{fill:url(' || CASE page_id % 3 WHEN 0 THEN '#g' WHEN 1 THEN '' ELSE 'data:image/png;base64,AA' END || ')}</style>'
  || '<rect width="' || page_id || '"/>' || '<a' || CASE page_id % 4 WHEN 0 THEN ' xlink:href="#ok"' WHEN 3 THEN ' xlink:href="data:image/gif;x"' ELSE '' END || '>t</a></svg>' AS clean, true AS is_svg FROM pages"""


def g3_hostile(spark, sf):
    """Prefixed and nested active elements, prefixed links, styles with nested parentheses, and images that do not parse."""
    n = F.col("page_id") % 9
    body = F.element_at(F.array(*map(F.lit, [source for source, _ in _HOSTILE])), (n + 1).cast("int"))
    made = view(spark, sf, "pages").select("page_id", svg.sanitize(F.encode(F.concat(F.lit("<svg>"), body, F.lit("</svg>")), "UTF-8")).alias("s"))
    return made.select("page_id", "s.clean", F.substring_index("s.error", ":", 1).alias("error"))


_HOSTILE = [
    ("<svg:script>x</svg:script>", ""), ("<foreignObject><g><foreignObject/></g>y</foreignObject><g/>", "<g/>"),
    ("<s:A x:HREF='file:///e' b=\"1\">t</s:A>", '<s:A b="1">t</s:A>'), ("<style>a{b:url(c(d)e)} f{g:url( '#h' )}</style>", "<style>a{b:url()} f{g:url( '#h' )}</style>"),
    ("<style><![CDATA[@IMPORT 'a';b>c{d:URL(//e)}]]></style>", "<style>b&gt;c{d:url()}</style>"), ("<g style='a:url(http://b);c:d' ONload='e'/>", '<g style="a:url();c:d"/>'),
    ("<g xml:base='http://a' on='b'><!--c--><![CDATA[<d>]]></g>", '<g on="b"><!--c--><![CDATA[<d>]]></g>'), ("<g>", None), ("&#106;<a href='&#106;avascript:x'/>&amp;", "j<a/>&amp;"),
]
G3 = "SELECT page_id, CASE page_id % 9 " + " ".join(
    f"WHEN {k} THEN '" + f"<svg>{clean}</svg>".replace("'", "''") + "'" for k, (_, clean) in enumerate(_HOSTILE) if clean is not None
) + " END AS clean, CASE WHEN page_id % 9 = 7 THEN 'DecodeFailed' END AS error FROM pages"


def g4_links(spark, sf):
    href = F.when(F.col("page_id") % 6 == 0, "").when(F.col("page_id") % 6 == 1, "  #frag").when(F.col("page_id") % 6 == 2, "DATA:image/PNG;base64,x").when(
        F.col("page_id") % 6 == 3, "data:image/svg+xml,x").when(F.col("page_id") % 6 == 4, "data:text/html,x").otherwise(F.col("url"))
    return view(spark, sf, "pages").select("page_id", svg.is_dangerous_href(href).alias("dangerous"))


G4 = "SELECT page_id, page_id % 6 >= 3 AS dangerous FROM pages"


def g7_straight(spark, sf):
    c, a = F.col("l_partkey") % 256, F.col("l_orderkey") % 256
    return view(spark, sf, "lineitem").select(svg.straight(c, a).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("n"))


G7 = """SELECT (CASE WHEN l_orderkey % 256 = 0 THEN 0 ELSE least(((l_partkey % 256) * 255 + (l_orderkey % 256) // 2) // (l_orderkey % 256), 255) END)::BIGINT AS v, count(*) AS n FROM lineitem GROUP BY 1"""

QUERIES = {
    "n1_accept": (n1_accept, N1), "n4_negotiate": (n4_negotiate, N4), "n5_etags": (n5_etags, N5), "n6_not_modified": (n6_not_modified, N6), "n7_headers": (n7_headers, N7),
    "a2_canonical": (a2_canonical, A2), "a3_sign": (a3_sign, A3), "a4_verify": (a4_verify, A4), "a5_names": (a5_names, A5), "a7_expiry": (a7_expiry, A7),
    "u1_urls": (u1_urls, U1), "u2_denied": (u2_denied, U2), "u7_client": (u7_client, U7), "s5_object_urls": (s5_object_urls, S5), "s7_redirects": (s7_redirects, S7),
    "c2_watermark_identity": (c2_watermark_identity, C2), "c3_version_hash": (c3_version_hash, C3), "c4_lookup": (c4_lookup, C4), "c5_shards": (c5_shards, C5),
    "c6_evict": (c6_evict, C6), "c9_two_stage": (c9_two_stage, C9), "r1_token_bucket": (r1_token_bucket, R1), "r4_in_flight": (r4_in_flight, R4),
    "h1_hysteresis": (h1_hysteresis, H1), "h2_readiness": (h2_readiness, H2), "o1_counters": (o1_counters, O1), "o2_histogram": (o2_histogram, O2),
    "o3_statuses": (o3_statuses, O3), "o4_rate": (o4_rate, O4), "o4_hit_ratio": (o4_hit_ratio, O4B), "o4_quantile": (o4_quantile, O4C),
    "k4_problems": (k4_problems, K4), "k6_access_log": (k6_access_log, K6), "k7_exposition": (k7_exposition, K7),
    "g2_sanitize": (g2_sanitize, G2), "g3_hostile": (g3_hostile, G3), "g4_links": (g4_links, G4), "g7_straight": (g7_straight, G7),
}
