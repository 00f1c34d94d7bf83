"""Queries over transform requests: sniffing, parsing, validation, geometry, cache keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry, media, parse, urls
from ..operators import cache, validate
from ..sources.views import duck, view

_FMT = "coalesce(format, input_type)"
_FLAGS = {
    "optimizable": "('jpeg','png','webp','avif')", "lossy": "('jpeg','webp','avif')", "icc": "('jpeg','png','webp')",
    "raster": "('jpeg','png','webp','avif','bmp','tiff')",
}
_ERROR_SQL = f"""CASE
  WHEN width = 0 THEN 'width must be greater than zero'
  WHEN height = 0 THEN 'height must be greater than zero'
  WHEN quality < 1 OR quality > 100 THEN 'quality must be between 1 and 100'
  WHEN target_metric = 'ssim' AND (target_value <= 0 OR target_value > 1) THEN 'ssim targetQuality must be greater than 0.0 and at most 1.0'
  WHEN target_metric = 'psnr' AND target_value <= 0 THEN 'psnr targetQuality must be greater than 0'
  WHEN blur < 0.1 OR blur > 100 THEN 'blur sigma must be between 0.1 and 100.0'
  WHEN sharpen < 0.1 OR sharpen > 100 THEN 'sharpen sigma must be between 0.1 and 100.0'
  WHEN crop_width = 0 OR crop_height = 0 THEN 'crop width and height must be greater than zero'
  WHEN fit IS NOT NULL AND (width IS NULL OR height IS NULL) THEN 'fit requires both width and height'
  WHEN position IS NOT NULL AND (width IS NULL OR height IS NULL) THEN 'position requires both width and height'
  WHEN preserve_exif AND strip_metadata THEN 'preserve_exif requires strip_metadata to be false'
  WHEN optimize <> 'none' AND {_FMT} NOT IN {_FLAGS['optimizable']} THEN 'optimization is not supported for ' || {_FMT} || ' output'
  WHEN optimize = 'lossy' AND {_FMT} NOT IN {_FLAGS['lossy']} THEN 'lossy optimization requires jpeg, webp, or avif output, got ' || {_FMT}
  WHEN preserve_exif AND {_FMT} = 'svg' THEN 'preserveExif is not supported with SVG output'
  WHEN quality IS NOT NULL AND {_FMT} NOT IN {_FLAGS['lossy']} THEN 'quality requires a lossy output format'
  WHEN quality IS NOT NULL AND optimize = 'lossless' THEN 'quality cannot be combined with optimize=lossless'
  WHEN target_metric IS NOT NULL AND optimize IN ('none', 'lossless') THEN 'targetQuality requires optimize=auto or optimize=lossy'
  WHEN target_metric IS NOT NULL AND {_FMT} NOT IN {_FLAGS['lossy']} THEN 'targetQuality requires jpeg, webp, or avif output'
END"""
_POLICY_SQL = f"""CASE WHEN preserve_exif THEN 'preserve_exif'
  WHEN strip_metadata AND optimize = 'lossy' AND {_FMT} IN {_FLAGS['icc']} THEN 'preserve_icc'
  WHEN strip_metadata THEN 'strip_all' ELSE 'keep_all' END"""


def d1_sniff(spark, sf):
    found = view(spark, sf, "hdr").select("req_id", "kind", media.sniff(F.unhex("header")).alias("media_type"))
    return found.groupBy("kind", "media_type").agg(F.count(F.lit(1)).alias("n"))


D1 = duck("hdr") + "SELECT kind, CASE WHEN kind <> 'gif' THEN kind END AS media_type, count(*) AS n FROM hdr GROUP BY 1, 2"


def d2_headers(spark, sf):
    h = view(spark, sf, "hdr").select("req_id", media.header(F.unhex("header")).alias("h"))
    return h.select("req_id", "h.media_type", "h.width", "h.height", "h.has_alpha")


D2 = duck("hdr") + """SELECT req_id, CASE WHEN kind <> 'gif' THEN kind END AS media_type,
  CASE WHEN kind NOT IN ('gif', 'svg') THEN w END AS width, CASE WHEN kind NOT IN ('gif', 'svg') THEN h END AS height,
  CASE kind WHEN 'jpeg' THEN false WHEN 'svg' THEN true WHEN 'gif' THEN NULL ELSE alpha END AS has_alpha FROM hdr"""


def d9_type_flags(spark, sf):
    req = view(spark, sf, "req").withColumn("name", F.coalesce("format", "input_type"))
    return req.join(F.broadcast(media.media_types(spark)), "name").groupBy("name", "mime", "lossy", "icc", "raster").agg(
        F.count(F.lit(1)).alias("n"))


D9 = duck("req") + f"""SELECT {_FMT} AS name, CASE {_FMT} WHEN 'svg' THEN 'image/svg+xml' ELSE 'image/' || {_FMT} END AS mime,
  {_FMT} IN {_FLAGS['lossy']} AS lossy, {_FMT} IN {_FLAGS['icc']} AS icc, {_FMT} IN {_FLAGS['raster']} AS raster, count(*) AS n
FROM req GROUP BY ALL"""


def p1_media_type(spark, sf):
    return view(spark, sf, "texts").select("req_id", "media", media.parse_media_type(F.col("media")).alias("media_type"))


P1 = duck("texts") + """SELECT req_id, media, CASE media WHEN 'jpg' THEN 'jpeg' WHEN 'tif' THEN 'tiff' WHEN 'JPEG' THEN NULL
  WHEN 'gif' THEN NULL ELSE media END AS media_type FROM texts"""


def p2_crop(spark, sf):
    c = view(spark, sf, "texts").select("req_id", parse.crop(F.col("crop")).alias("c"))
    return c.select("req_id", "c.x", "c.y", F.col("c.width").alias("w"), F.col("c.height").alias("h"), "c.error")


P2 = duck("texts") + """, s AS (SELECT req_id, crop, string_split(crop, ',') AS p FROM texts),
n AS (SELECT *, list_transform(p, lambda t: CASE WHEN regexp_full_match(t, '\\+?[0-9]+') AND try_cast(t AS HUGEINT) < 4294967296
        THEN try_cast(t AS BIGINT) END) AS v FROM s),
e AS (SELECT *, CASE WHEN len(p) <> 4 THEN 'crop must be x,y,w,h (four comma-separated integers), got ''' || crop || ''''
  WHEN v[1] IS NULL THEN 'crop x must be a non-negative integer, got ''' || p[1] || ''''
  WHEN v[2] IS NULL THEN 'crop y must be a non-negative integer, got ''' || p[2] || ''''
  WHEN v[3] IS NULL THEN 'crop width must be a non-negative integer, got ''' || p[3] || ''''
  WHEN v[4] IS NULL THEN 'crop height must be a non-negative integer, got ''' || p[4] || ''''
  WHEN v[3] = 0 OR v[4] = 0 THEN 'crop width and height must be greater than zero' END AS error FROM n)
SELECT req_id, CASE WHEN error IS NULL THEN v[1] END AS x, CASE WHEN error IS NULL THEN v[2] END AS y,
  CASE WHEN error IS NULL THEN v[3] END AS w, CASE WHEN error IS NULL THEN v[4] END AS h, error FROM e"""


def p3_target_quality(spark, sf):
    t = view(spark, sf, "texts").select("req_id", parse.target_quality(F.col("target")).alias("t"))
    return t.select("req_id", "t.metric", F.round("t.value", 4).alias("value"), "t.error")


P3 = duck("texts") + """, s AS (SELECT req_id, target, strpos(target, ':') AS colon, lower(split_part(target, ':', 1)) AS metric,
  substr(target, strpos(target, ':') + 1) AS raw FROM texts),
n AS (SELECT *, CASE WHEN regexp_full_match(raw, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') THEN try_cast(raw AS FLOAT) END AS value FROM s),
e AS (SELECT *, CASE WHEN colon = 0 THEN 'targetQuality must be <metric>:<value>, for example ssim:0.98'
  WHEN metric NOT IN ('ssim', 'psnr') THEN 'unsupported quality metric `' || metric || '`'
  WHEN value IS NULL THEN 'target quality value must be a number, got `' || raw || '`' END AS error FROM n)
SELECT req_id, CASE WHEN error IS NULL THEN metric END AS metric, CASE WHEN error IS NULL THEN round(value::DOUBLE, 4) END AS value, error FROM e"""


def p4_colour(spark, sf):
    c = view(spark, sf, "texts").select("req_id", parse.colour(F.col("colour")).alias("c"))
    return c.select("req_id", "c.r", "c.g", "c.b", F.col("c.a").cast("long").alias("a"), "c.error")


P4 = duck("texts") + """, v AS (SELECT *, regexp_full_match(colour, '[0-9a-fA-F]{6}|[0-9a-fA-F]{8}') AS ok FROM texts)
SELECT req_id, CASE WHEN ok THEN ('0x' || substr(colour, 1, 2))::BIGINT END AS r, CASE WHEN ok THEN ('0x' || substr(colour, 3, 2))::BIGINT END AS g,
  CASE WHEN ok THEN ('0x' || substr(colour, 5, 2))::BIGINT END AS b,
  CASE WHEN ok THEN CASE WHEN length(colour) = 8 THEN ('0x' || substr(colour, 7, 2))::BIGINT ELSE 255 END END AS a,
  CASE WHEN NOT ok THEN 'unsupported color `' || colour || '`' END AS error FROM v"""


def p5_enums(spark, sf):
    req = view(spark, sf, "req")
    return req.groupBy(
        parse.one_of(F.col("fit"), parse.FITS).alias("fit"), parse.one_of(F.col("position"), parse.POSITIONS).alias("position"),
        parse.one_of(F.col("optimize"), parse.MODES).alias("mode"),
    ).agg(F.count(F.lit(1)).alias("n"))


P5 = duck("req") + "SELECT fit, position, optimize AS mode, count(*) AS n FROM req GROUP BY ALL"


def p7_presets(spark, sf):
    presets = spark.createDataFrame([("thumb", 120, 80, "webp"), ("hero", 1600, 900, "avif")], "name string, width long, height long, format string")
    merged = validate.merge_presets(view(spark, sf, "req").select("req_id", "preset", "width", "height", "format"), presets, ["width", "height", "format"])
    return merged.select("req_id", "width", "height", "format", "error")


P7 = duck("req") + """, p AS (FROM (VALUES ('thumb', 120, 80, 'webp'), ('hero', 1600, 900, 'avif')) AS t(name, w, h, f))
SELECT req_id, coalesce(width, w)::BIGINT AS width, coalesce(height, h)::BIGINT AS height, coalesce(format, f) AS format,
  CASE WHEN preset IS NOT NULL AND name IS NULL THEN 'unknown preset `' || preset || '`' END AS error FROM req LEFT JOIN p ON preset = name"""


def p9_query(spark, sf):
    pairs = parse.query_pairs(F.col("query"))
    return view(spark, sf, "texts").select("req_id", pairs.alias("pairs")).select(
        "req_id", F.size("pairs").cast("long").alias("n_pairs"), parse.has_duplicates(F.col("pairs")).alias("duplicate"),
        F.array_join(F.transform("pairs", lambda p: F.concat(p["name"], F.lit("\x1f"), p["value"])), "\x1e").alias("decoded"),
    )


P9 = duck("texts") + """, s AS (SELECT req_id, list_filter(string_split(query, '&'), lambda x: x <> '') AS l FROM texts),
d AS (SELECT req_id, list_transform(l, lambda x: {'n': url_decode(replace(split_part(x, '=', 1), '+', ' ')),
  'v': CASE WHEN strpos(x, '=') > 0 THEN url_decode(replace(substr(x, strpos(x, '=') + 1), '+', ' ')) ELSE '' END}) AS p FROM s)
SELECT req_id, len(p)::BIGINT AS n_pairs, len(list_distinct(list_transform(p, lambda x: x.n))) < len(p) AS duplicate,
  array_to_string(list_transform(p, lambda x: x.n || chr(31) || x.v), chr(30)) AS decoded FROM d"""


def p11_metadata_flags(spark, sf):
    f = view(spark, sf, "texts").select(parse.metadata_flags(F.col("strip"), F.col("keep"), F.col("exif")).alias("f"))
    return f.groupBy("f.strip_metadata", "f.preserve_exif", "f.error").agg(F.count(F.lit(1)).alias("n"))


P11 = duck("texts") + """, e AS (SELECT *, coalesce(keep, false) AS k, coalesce(exif, false) AS x FROM texts)
SELECT CASE WHEN NOT (k AND x) THEN NOT (k OR x) AND coalesce(strip, true) END AS strip_metadata, CASE WHEN NOT (k AND x) THEN x END AS preserve_exif,
  CASE WHEN k AND x THEN 'keepMetadata and preserveExif cannot both be true' END AS error, count(*) AS n FROM e GROUP BY ALL"""


def p15_gzip(spark, sf):
    return view(spark, sf, "texts").groupBy("encodings", parse.accepts_gzip(F.col("encodings")).alias("gzip")).agg(F.count(F.lit(1)).alias("n"))


P15 = duck("texts") + """SELECT encodings, encodings IN ('gzip', '*', 'deflate, GZIP;q=0.5') AS gzip, count(*) AS n FROM texts GROUP BY ALL"""


def v_first_error(spark, sf):
    req = view(spark, sf, "req")
    return req.select("req_id", validate.first_error(req).alias("error"))


V1 = duck("req") + f"SELECT req_id, {_ERROR_SQL} AS error FROM req"


def v17_normalized(spark, sf):
    good = validate.normalize(view(spark, sf, "req")).where("error IS NULL")
    return good.groupBy("fmt", "fit", "position", "policy").agg(F.count(F.lit(1)).alias("n"))


V17 = duck("req") + f"""SELECT {_FMT} AS fmt, CASE WHEN width IS NOT NULL AND height IS NOT NULL THEN coalesce(fit, 'contain') END AS fit,
  coalesce(position, 'center') AS position, {_POLICY_SQL} AS policy, count(*) AS n FROM req WHERE ({_ERROR_SQL}) IS NULL GROUP BY ALL"""


def v18_watermark(spark, sf):
    req = view(spark, sf, "req")
    return req.select("req_id", validate.watermark_error(F.col("req_id") % 105, validate.output_format(req)).alias("error"))


V18 = duck("req") + f"""SELECT req_id, CASE WHEN req_id % 105 < 1 OR req_id % 105 > 100 THEN 'watermark opacity must be between 1 and 100'
  WHEN {_FMT} = 'svg' THEN 'watermark image must be a raster format' END AS error FROM req"""


def v19_svg(spark, sf):
    req = view(spark, sf, "req")
    return req.groupBy(validate.svg_error(req, F.col("req_id") % 9 == 2).alias("error")).agg(F.count(F.lit(1)).alias("n"))


V19 = duck("req") + """SELECT list_filter([CASE WHEN blur IS NOT NULL THEN 'blur' END, CASE WHEN sharpen IS NOT NULL THEN 'sharpen' END,
  CASE WHEN req_id % 9 = 2 THEN 'watermark' END, CASE WHEN crop_width IS NOT NULL THEN 'crop' END], lambda w: w IS NOT NULL)[1] || ' is not supported for SVG inputs' AS error,
  count(*) AS n FROM req GROUP BY ALL"""


def v21_pixel_limits(spark, sf):
    d = view(spark, sf, "dims").withColumns({"w": F.col("w") * 10, "h": F.col("h") * 4})
    ow, oh = geometry.output_size(F.col("w"), F.col("h"), F.col("tw") * 10, F.col("th") * 6)
    d = d.withColumns({"ow": ow, "oh": oh})
    return d.groupBy("media").agg(
        F.count_if(validate.input_error(F.col("w"), F.col("h")).isNotNull()).alias("input_refused"),
        F.count_if(validate.output_error(F.col("ow"), F.col("oh")).isNotNull()).alias("output_refused"),
        F.count(F.lit(1)).alias("n"), F.sum(F.col("ow") * F.col("oh")).alias("pixels"),
    )


_SIZE = """CASE WHEN tw IS NOT NULL THEN tw WHEN th IS NOT NULL THEN greatest(1, round(w::DOUBLE * th / h))::BIGINT ELSE w END AS ow,
  CASE WHEN th IS NOT NULL THEN th WHEN tw IS NOT NULL THEN greatest(1, round(h::DOUBLE * tw / w))::BIGINT ELSE h END AS oh"""
V21 = duck("dims") + f""", d AS (SELECT media, w * 10 AS w, h * 4 AS h, tw * 10 AS tw, th * 6 AS th FROM dims),
o AS (SELECT *, {_SIZE} FROM d)
SELECT media, count(*) FILTER (w * h > 100000000) AS input_refused, count(*) FILTER (ow * oh > 67108864) AS output_refused, count(*) AS n,
  sum(ow * oh)::BIGINT AS pixels FROM o GROUP BY media"""


def t4_output_size(spark, sf):
    w, h = geometry.output_size(*(F.col(c) for c in ("w", "h", "tw", "th")))
    return view(spark, sf, "dims").select("order_id", "line", w.alias("ow"), h.alias("oh"))


T4 = duck("dims") + f"SELECT order_id, line, {_SIZE} FROM dims"


def t7_fit_sizes(spark, sf):
    d = view(spark, sf, "dims").where("tw IS NOT NULL AND th IS NOT NULL")
    cols = [F.col(c) for c in ("w", "h", "tw", "th")]
    (cw, ch), (iw, ih), (vw, vh) = geometry.contain_size(*cols), geometry.inside_size(*cols), geometry.cover_size(*cols)
    return d.select("order_id", "line", cw.alias("contain_w"), ch.alias("contain_h"), iw.alias("inside_w"), ih.alias("inside_h"), vw.alias("cover_w"), vh.alias("cover_h"))


T7 = duck("dims") + """, d AS (SELECT *, least(tw::DOUBLE / w, th::DOUBLE / h) AS lo, greatest(tw::DOUBLE / w, th::DOUBLE / h) AS hi FROM dims
  WHERE tw IS NOT NULL AND th IS NOT NULL)
SELECT order_id, line, greatest(1, round(w * lo))::BIGINT AS contain_w, greatest(1, round(h * lo))::BIGINT AS contain_h,
  CASE WHEN w <= tw AND h <= th THEN w ELSE greatest(1, round(w * lo))::BIGINT END AS inside_w,
  CASE WHEN w <= tw AND h <= th THEN h ELSE greatest(1, round(h * lo))::BIGINT END AS inside_h,
  greatest(1, ceil(w * hi))::BIGINT AS cover_w, greatest(1, ceil(h * hi))::BIGINT AS cover_h FROM d"""


def t11_offsets(spark, sf):
    d = view(spark, sf, "dims").where("tw IS NOT NULL AND th IS NOT NULL")
    x, y = geometry.offset(F.col("w"), F.col("h"), F.col("tw"), F.col("th"), F.col("position"))
    mx, my = geometry.watermark_offset(F.col("w"), F.col("h"), F.col("tw"), F.col("th"), F.col("position"), F.lit(10))
    fits = geometry.watermark_fits(F.col("w"), F.col("h"), F.col("tw"), F.col("th"), F.col("position"), F.lit(10))
    return d.select("order_id", "line", "position", x.alias("x"), y.alias("y"), mx.alias("mark_x"), my.alias("mark_y"), fits.alias("mark_fits"))


T11 = duck("dims") + """, d AS (SELECT *, greatest(w - tw, 0) AS sx, greatest(h - th, 0) AS sy, position LIKE '%left' AS l, position LIKE '%right' AS r,
  position LIKE 'top%' AS t, position LIKE 'bottom%' AS b FROM dims WHERE tw IS NOT NULL AND th IS NOT NULL)
SELECT order_id, line, position, CASE WHEN l THEN 0 WHEN r THEN sx ELSE sx // 2 END AS x, CASE WHEN t THEN 0 WHEN b THEN sy ELSE sy // 2 END AS y,
  CASE WHEN l THEN 10 WHEN r THEN greatest(sx - 10, 0) ELSE sx // 2 END AS mark_x, CASE WHEN t THEN 10 WHEN b THEN greatest(sy - 10, 0) ELSE sy // 2 END AS mark_y,
  tw + CASE WHEN l OR r THEN 10 ELSE 0 END <= w AND th + CASE WHEN t OR b THEN 10 ELSE 0 END <= h AS mark_fits FROM d"""


def g6_render_size(spark, sf):
    w, h = geometry.render_size(F.col("w") % 3000, F.col("h") % 2000, F.col("tw"), F.col("th"))
    return view(spark, sf, "dims").select("order_id", "line", w.alias("rw"), h.alias("rh"))


G6 = duck("dims") + """, d AS (SELECT *, w % 3000 AS iw, h % 2000 AS ih FROM dims)
SELECT order_id, line, greatest(1, CASE WHEN tw IS NOT NULL THEN tw WHEN th IS NOT NULL THEN CASE WHEN ih > 0 THEN round(th::DOUBLE * iw / ih) ELSE iw END
    WHEN iw > 0 THEN iw ELSE 300 END)::BIGINT AS rw,
  greatest(1, CASE WHEN th IS NOT NULL THEN th WHEN tw IS NOT NULL THEN CASE WHEN iw > 0 THEN round(tw::DOUBLE * ih / iw) ELSE ih END
    WHEN ih > 0 THEN ih ELSE 150 END)::BIGINT AS rh FROM d"""


def s1_paths(spark, sf):
    return view(spark, sf, "texts").groupBy(urls.path_error(F.col("path")).alias("error")).agg(F.count(F.lit(1)).alias("n"))


S1 = duck("texts") + """SELECT CASE WHEN ltrim(path, '/') = '' THEN 'source path must not be empty'
  WHEN list_contains(string_split(ltrim(path, '/'), '/'), '..') OR split_part(ltrim(path, '/'), '/', 1) = '.'
  THEN 'source path must not contain root, current-directory, or parent-directory segments' END AS error, count(*) AS n FROM texts GROUP BY ALL"""


def v26_keys(spark, sf):
    key = F.when(F.col("doc_id") % 7 == 0, F.lit("")).when(F.col("doc_id") % 7 == 1, F.concat(F.col("object_key"), F.lit("\n"))).when(
        F.col("doc_id") % 7 == 2, F.rpad("object_key", 1100, "k")).otherwise(F.col("object_key"))
    return view(spark, sf, "blob").groupBy(urls.key_error(key).alias("error")).agg(F.count(F.lit(1)).alias("n"))


V26 = duck("blob") + """SELECT CASE doc_id % 7 WHEN 0 THEN 'S3 key must not be empty'
  WHEN 1 THEN 'S3 key contains invalid characters (null, newline, or carriage return)'
  WHEN 2 THEN 'S3 key exceeds the maximum allowed length of 1024 bytes' END AS error, count(*) AS n FROM blob GROUP BY ALL"""


def c1_cache_key(spark, sf):
    req = view(spark, sf, "req")
    params = cache.parameters(req)
    return req.select("req_id", params.alias("params"), cache.cache_key(F.col("source_path"), params).alias("key"))


_C1_PARAMS = """concat_ws('&', CASE WHEN auto_orient THEN 'autoOrient=true' END,
  'background=' || CASE WHEN length(background) = 6 THEN background || 'ff' ELSE background END,
  'blur=' || CASE WHEN blur = floor(blur) THEN floor(blur)::BIGINT::VARCHAR ELSE blur::VARCHAR END,
  'crop=0,0,' || crop_width || ',' || crop_height,
  CASE WHEN width IS NOT NULL AND height IS NOT NULL THEN 'fit=' || coalesce(fit, 'contain') END, 'format=' || format, 'height=' || height,
  CASE WHEN optimize <> 'none' THEN 'optimize=' || optimize END,
  CASE WHEN width IS NOT NULL AND height IS NOT NULL THEN 'position=' || coalesce(position, 'center') END,
  CASE WHEN preserve_exif THEN 'preserveExif=true' END, 'quality=' || quality,
  'targetQuality=' || CASE WHEN target_metric IS NOT NULL THEN target_metric || ':' ||
      CASE WHEN target_value = floor(target_value) THEN floor(target_value)::BIGINT::VARCHAR ELSE target_value::VARCHAR END
    WHEN optimize IN ('auto', 'lossy') AND quality IS NULL THEN CASE format WHEN 'jpeg' THEN 'ssim:0.985' WHEN 'webp' THEN 'ssim:0.985' WHEN 'avif' THEN 'ssim:0.99' END END,
  CASE WHEN rotate <> 0 THEN 'rotate=' || rotate END,
  'sharpen=' || CASE WHEN sharpen = floor(sharpen) THEN floor(sharpen)::BIGINT::VARCHAR ELSE sharpen::VARCHAR END,
  CASE WHEN strip_metadata THEN 'stripMetadata=true' END, 'width=' || width)"""
C1 = duck("req") + f""", p AS (SELECT req_id, source_path, {_C1_PARAMS} AS params FROM req)
SELECT req_id, params, sha256(source_path || chr(10) || params || chr(10) || chr(10)) AS key FROM p"""


def flagship(spark, sf):
    """Requests by result: validated, sized, keyed, made distinct and counted."""
    req = validate.normalize(view(spark, sf, "req"))
    w, h = geometry.output_size(F.lit(4000), F.lit(3000), F.col("width"), F.col("height"))
    keyed = req.select(
        cache.cache_key(F.col("source_path"), cache.parameters(req)).alias("key"),
        F.struct("req_id", "fmt", "fit", "error", F.when(F.col("error").isNull(), w * h).alias("pixels")).alias("row"),
    )
    # of the requests with one key the first counts
    first = keyed.groupBy("key").agg(F.min("row").alias("row")).select("row.*")
    return first.groupBy("fmt", "fit", "error").agg(
        F.count(F.lit(1)).alias("n"), F.sum("pixels").alias("pixels"), F.max("pixels").alias("largest"))


FLAGSHIP = duck("req") + f""", p AS (SELECT {_FMT} AS fmt, CASE WHEN width IS NOT NULL AND height IS NOT NULL THEN coalesce(fit, 'contain') END AS fit,
  {_ERROR_SQL} AS error, source_path || chr(10) || {_C1_PARAMS} AS key, 4000 AS w, 3000 AS h, width AS tw, height AS th, req_id FROM req),
o AS (SELECT *, {_SIZE} FROM p), d AS (SELECT DISTINCT ON (key) * FROM o ORDER BY key, req_id)
SELECT fmt, fit, error, count(*) AS n, sum(CASE WHEN error IS NULL THEN ow * oh END)::BIGINT AS pixels,
  max(CASE WHEN error IS NULL THEN ow * oh END)::BIGINT AS largest FROM d GROUP BY ALL"""

QUERIES = {
    "flagship": (flagship, FLAGSHIP), "d1_sniff": (d1_sniff, D1), "d2_headers": (d2_headers, D2), "d9_type_flags": (d9_type_flags, D9),
    "p1_media_type": (p1_media_type, P1), "p2_crop": (p2_crop, P2), "p3_target_quality": (p3_target_quality, P3), "p4_colour": (p4_colour, P4),
    "p5_enums": (p5_enums, P5), "p7_presets": (p7_presets, P7), "p9_query": (p9_query, P9), "p11_metadata_flags": (p11_metadata_flags, P11),
    "p15_gzip": (p15_gzip, P15), "v_first_error": (v_first_error, V1), "v17_normalized": (v17_normalized, V17), "v18_watermark": (v18_watermark, V18),
    "v19_svg": (v19_svg, V19), "v21_pixel_limits": (v21_pixel_limits, V21), "t4_output_size": (t4_output_size, T4), "t7_fit_sizes": (t7_fit_sizes, T7),
    "t11_offsets": (t11_offsets, T11), "g6_render_size": (g6_render_size, G6), "s1_paths": (s1_paths, S1), "v26_keys": (v26_keys, V26),
    "c1_cache_key": (c1_cache_key, C1),
}
