"""Views of image requests, headers, logs and URLs, derived from the tables.

The tables hold no images, so each view makes its rows from keys by small
modular rules, invalid values included.  The SQL is understood by Spark and by
DuckDB alike; ``{name}`` stands for a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    # one transform request for each part
    "req": """
SELECT p_partkey AS req_id,
  CASE p_partkey % 4 WHEN 0 THEN 'jpeg' WHEN 1 THEN 'png' WHEN 2 THEN 'webp' ELSE 'bmp' END AS input_type,
  CASE WHEN p_partkey % 97 = 1 THEN 0 WHEN p_partkey % 5 = 0 THEN NULL ELSE CAST(p_size AS BIGINT) * 40 END AS width,
  CASE WHEN p_partkey % 89 = 2 THEN 0 WHEN p_partkey % 7 = 0 THEN NULL
       ELSE CAST(p_size AS BIGINT) * 30 + p_partkey % 11 END AS height,
  CASE p_partkey % 6 WHEN 0 THEN 'contain' WHEN 1 THEN 'cover' WHEN 2 THEN 'fill' WHEN 3 THEN 'inside' END AS fit,
  CASE p_partkey % 13 WHEN 0 THEN 'center' WHEN 1 THEN 'top' WHEN 2 THEN 'right' WHEN 3 THEN 'bottom' WHEN 4 THEN 'left'
    WHEN 5 THEN 'top-left' WHEN 6 THEN 'top-right' WHEN 7 THEN 'bottom-left' WHEN 8 THEN 'bottom-right' END AS position,
  CASE p_partkey % 9 WHEN 0 THEN 'jpeg' WHEN 1 THEN 'png' WHEN 2 THEN 'webp' WHEN 3 THEN 'avif' WHEN 4 THEN 'svg'
    WHEN 5 THEN 'bmp' WHEN 6 THEN 'tiff' END AS format,
  CASE WHEN p_partkey % 8 = 0 THEN p_partkey % 103 END AS quality,
  CASE p_partkey % 10 WHEN 1 THEN 'auto' WHEN 3 THEN 'lossless' WHEN 5 THEN 'lossy' WHEN 7 THEN 'lossy' ELSE 'none' END AS optimize,
  CASE p_partkey % 16 WHEN 3 THEN 'ssim' WHEN 5 THEN 'psnr' END AS target_metric,
  CASE WHEN p_partkey % 16 IN (3, 5) THEN CAST(p_partkey % 30 AS DOUBLE) / 20 END AS target_value,
  CASE WHEN p_partkey % 12 = 4 THEN CAST(p_partkey % 300 AS DOUBLE) / 2 END AS blur,
  CASE WHEN p_partkey % 15 = 7 THEN CAST(p_partkey % 250 AS DOUBLE) / 2 END AS sharpen,
  CASE WHEN p_partkey % 14 = 6 THEN p_partkey % 50 END AS crop_width,
  CASE WHEN p_partkey % 14 = 6 THEN p_partkey % 40 END AS crop_height,
  (p_partkey % 4) * 90 AS rotate,
  CASE WHEN p_partkey % 11 = 5 THEN 'ff8800' WHEN p_partkey % 11 = 6 THEN '10203040' END AS background,
  p_partkey % 3 <> 0 AS strip_metadata, p_partkey % 20 = 9 AS preserve_exif, p_partkey % 2 = 0 AS auto_orient,
  CASE p_partkey % 10 WHEN 2 THEN 'thumb' WHEN 4 THEN 'hero' WHEN 6 THEN 'missing' END AS preset,
  p_name AS source_path
FROM {part}""",
    # texts as a client would send them
    "texts": """
SELECT p_partkey AS req_id,
  CASE p_partkey % 10 WHEN 0 THEN '1,2,3' WHEN 1 THEN 'a,0,10,10' WHEN 2 THEN '0,-1,10,10' WHEN 3 THEN '0,0,1.5,4'
    WHEN 4 THEN '0,0,10,x' WHEN 5 THEN '0,0,0,7' WHEN 6 THEN '+1,2,3,4' WHEN 7 THEN '0,0,4294967296,1'
    ELSE CAST(p_partkey % 50 AS VARCHAR(20)) || ',0,' || CAST(p_size AS VARCHAR(20)) || ',8' END AS crop,
  CASE p_partkey % 8 WHEN 0 THEN 'ssim' WHEN 1 THEN 'vmaf:0.9' WHEN 2 THEN 'SSIM:0.98' WHEN 3 THEN 'psnr:abc'
    WHEN 4 THEN 'psnr: 40' WHEN 5 THEN 'psnr:4e1' WHEN 6 THEN 'ssim:.5'
    ELSE 'psnr:' || CAST(p_size AS VARCHAR(20)) END AS target,
  CASE p_partkey % 7 WHEN 0 THEN 'ff8800' WHEN 1 THEN '#ff8800' WHEN 2 THEN 'FF8800cc' WHEN 3 THEN 'fff' WHEN 4 THEN 'gg0000'
    WHEN 5 THEN '' ELSE lower(lpad(hex(CAST(p_partkey AS BIGINT) * 7919), 6, '0')) END AS colour,
  CASE p_partkey % 9 WHEN 0 THEN 'jpg' WHEN 1 THEN 'jpeg' WHEN 2 THEN 'JPEG' WHEN 3 THEN 'tif' WHEN 4 THEN 'webp'
    WHEN 5 THEN 'gif' WHEN 6 THEN 'svg' WHEN 7 THEN 'bmp' ELSE 'png' END AS media,
  CASE p_partkey % 6 WHEN 0 THEN 'path=/a%20b.jpg&width=' || CAST(p_size AS VARCHAR(20)) WHEN 1 THEN 'width=1&width=2'
    WHEN 2 THEN 'url=https%3A%2F%2Fexample.com%2F%C3%A9.png&bogus=1' WHEN 3 THEN 'a=1&&b' WHEN 4 THEN ''
    ELSE 'name=a+b&fit=cover' END AS query,
  CASE p_partkey % 6 WHEN 0 THEN '/photos/a.jpg' WHEN 1 THEN '../../etc/passwd' WHEN 2 THEN '///' WHEN 3 THEN 'a/./b.png'
    WHEN 4 THEN 'a//b.png' ELSE p_name || '.png' END AS path,
  CASE p_partkey % 7 WHEN 0 THEN true WHEN 1 THEN false END AS strip,
  CASE p_partkey % 5 WHEN 0 THEN true WHEN 1 THEN false END AS keep,
  CASE p_partkey % 4 WHEN 0 THEN true WHEN 1 THEN false END AS exif,
  CASE p_partkey % 8 WHEN 0 THEN 'gzip' WHEN 1 THEN 'br, gzip;q=0' WHEN 2 THEN '*' WHEN 3 THEN 'deflate, GZIP;q=0.5'
    WHEN 4 THEN '*;q=0' WHEN 5 THEN '' ELSE 'identity' END AS encodings
FROM {part}""",
    # image headers as hexadecimal text, with what they declare
    "hdr": """
SELECT req_id, kind, w, h, alpha, CASE kind
  WHEN 'png' THEN '89504E470D0A1A0A0000000D49484452' || lpad(hex(w), 8, '0') || lpad(hex(h), 8, '0') || '08'
    || CASE WHEN alpha THEN '06' ELSE '02' END || '000000'
  WHEN 'jpeg' THEN 'FFD8FFE00010' || '4A46494600010100000100010000' || CASE WHEN req_id % 2 = 0 THEN 'FFFE00040102' ELSE '' END
    || 'FFC0001108' || lpad(hex(h), 4, '0') || lpad(hex(w), 4, '0') || '03011100021100031100FFDA'
  WHEN 'webp' THEN '524946461600000057454250' || '565038580A000000' || CASE WHEN alpha THEN '10' ELSE '00' END || '000000'
    || substr(lpad(hex(w - 1), 6, '0'), 5, 2) || substr(lpad(hex(w - 1), 6, '0'), 3, 2) || substr(lpad(hex(w - 1), 6, '0'), 1, 2)
    || substr(lpad(hex(h - 1), 6, '0'), 5, 2) || substr(lpad(hex(h - 1), 6, '0'), 3, 2) || substr(lpad(hex(h - 1), 6, '0'), 1, 2)
  WHEN 'bmp' THEN '424D000000000000000036000000' || '28000000'
    || substr(lpad(hex(w), 8, '0'), 7, 2) || substr(lpad(hex(w), 8, '0'), 5, 2) || substr(lpad(hex(w), 8, '0'), 3, 2) || substr(lpad(hex(w), 8, '0'), 1, 2)
    || substr(stored_h, 7, 2) || substr(stored_h, 5, 2) || substr(stored_h, 3, 2) || substr(stored_h, 1, 2)
    || '0100' || CASE WHEN alpha THEN '2000' ELSE '1800' END
  WHEN 'svg' THEN '3C7376672077696474683D2231223E'
  ELSE '47494638396101000100' END AS header
FROM (
  SELECT p_partkey AS req_id,
    CASE p_partkey % 6 WHEN 0 THEN 'png' WHEN 1 THEN 'jpeg' WHEN 2 THEN 'webp' WHEN 3 THEN 'bmp' WHEN 4 THEN 'svg' ELSE 'gif' END AS kind,
    CAST(p_size AS BIGINT) * 17 + 1 AS w, CAST(p_size AS BIGINT) * 11 + p_partkey % 7 + 1 AS h, p_partkey % 4 < 2 AS alpha,
    lpad(hex(CASE WHEN p_partkey % 12 = 3 THEN 4294967296 - (CAST(p_size AS BIGINT) * 11 + p_partkey % 7 + 1)
                  ELSE CAST(p_size AS BIGINT) * 11 + p_partkey % 7 + 1 END), 8, '0') AS stored_h
  FROM {part}
) AS p""",
    # JPEG files piece by piece, in hexadecimal text, and the metadata that the pieces hold; empty pieces are left out
    "carrier": """
SELECT req_id, policy, exif, icc, xmp, iptc, seg_exif, seg_icc, seg_xmp, seg_iptc, seg_com, 'FFD8FFE000104A46494600010100000100010000' AS head,
  'FFC0001108000A000A03011100021100031100' || 'FFDA00040000' || '12FF0034' || 'FFD9' || 'AA' AS rest
FROM (
  SELECT *, CASE WHEN exif IS NULL THEN '' ELSE 'FFE1' || lpad(hex(CAST(length(exif) / 2 AS BIGINT) + 8), 4, '0') || '457869660000' || exif END AS seg_exif,
    CASE WHEN icc IS NULL THEN '' ELSE 'FFE2' || lpad(hex(CAST(length(icc) / 2 AS BIGINT) + 14), 4, '0') || '4943435F50524F46494C45000202' || substr(icc, 5)
      || 'FFE20012' || '4943435F50524F46494C45000102' || substr(icc, 1, 4) END AS seg_icc,
    CASE WHEN xmp IS NULL THEN '' ELSE 'FFE1' || lpad(hex(CAST(length(xmp) / 2 AS BIGINT) + 31), 4, '0') || hex('http://ns.adobe.com/xap/1.0/') || '00' || xmp END AS seg_xmp,
    CASE WHEN iptc IS NULL THEN '' ELSE 'FFED' || lpad(hex(CAST(floor((length(iptc) / 2 + 1) / 2) AS BIGINT) * 2 + 42), 4, '0') || hex('Photoshop 3.0') || '00'
      || hex('8BIM') || '03ED0000' || '00000001' || '0100' || hex('8BIM') || '04040000' || lpad(hex(CAST(length(iptc) / 2 AS BIGINT)), 8, '0') || iptc
      || CASE WHEN length(iptc) % 4 = 2 THEN '00' ELSE '' END END AS seg_iptc,
    CASE WHEN req_id % 4 = 1 THEN 'FFFE00044142' ELSE '' END AS seg_com
  FROM (
    SELECT p_partkey AS req_id, CASE p_partkey % 4 WHEN 0 THEN 'keep_all' WHEN 1 THEN 'preserve_icc' WHEN 2 THEN 'preserve_exif' ELSE 'strip_all' END AS policy,
      CASE WHEN p_partkey % 3 <> 0 THEN hex('MM exif of ' || CAST(p_partkey AS VARCHAR(20))) END AS exif,
      CASE WHEN p_partkey % 5 <> 0 THEN hex('profile ' || p_brand) END AS icc,
      CASE WHEN p_partkey % 7 <> 0 THEN hex('<x>' || CAST(p_partkey AS VARCHAR(20)) || '</x>') END AS xmp,
      CASE WHEN p_partkey % 11 <> 0 THEN hex('record ' || CAST(p_partkey AS VARCHAR(20))) END AS iptc
    FROM {part}
  ) AS p
) AS p""",
    # simple and extended WebP files
    "webp": """
SELECT *, '52494646' || '00000000' || '57454250' || own AS content FROM (
  SELECT *, before || image || after AS own FROM (
    SELECT p_partkey AS req_id, p_partkey % 4 AS shape, hex('exif ' || CAST(p_partkey AS VARCHAR(20))) AS exif,
      CASE WHEN p_partkey % 3 <> 0 THEN hex('icc' || CAST(p_partkey AS VARCHAR(20))) END AS icc, hex('<x>new</x>') AS xmp,
      CASE p_partkey % 4 WHEN 2 THEN '565038580A000000' || '14000000' || '090000' || '130000' ELSE '' END AS before,
      CASE p_partkey % 4 WHEN 1 THEN '5650384C05000000' || '2F09C00410' || '00' ELSE '565038200A000000' || '0000009D012A0A001400' END AS image,
      CASE p_partkey % 4 WHEN 2 THEN '584D502007000000' || hex('<x>old<') || '00' ELSE '' END AS after
    FROM {part}
  ) AS p
) AS p""",
    # source and target sizes in volume
    "dims": """
SELECT l_orderkey AS order_id, l_linenumber AS line, CAST(l_quantity AS BIGINT) * 100 AS w, CAST(l_linenumber AS BIGINT) * 500 AS h,
  CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE 100 + l_partkey % 1900 END AS tw,
  CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE 100 + l_suppkey % 900 END AS th,
  CASE l_partkey % 9 WHEN 0 THEN 'center' WHEN 1 THEN 'top' WHEN 2 THEN 'right' WHEN 3 THEN 'bottom' WHEN 4 THEN 'left'
    WHEN 5 THEN 'top-left' WHEN 6 THEN 'top-right' WHEN 7 THEN 'bottom-left' ELSE 'bottom-right' END AS position,
  CASE l_partkey % 5 WHEN 0 THEN 'png' WHEN 1 THEN 'webp' WHEN 2 THEN 'bmp' ELSE 'jpeg' END AS media
FROM {lineitem}""",
    # the access log
    "log": """
SELECT event_id, ts, user_id,
  CASE event_type WHEN 'signup' THEN 'POST' WHEN 'error' THEN 'POST' ELSE 'GET' END AS method,
  CASE event_type WHEN 'signup' THEN '/images' WHEN 'error' THEN '/images:transform' WHEN 'click' THEN '/images/by-path'
    WHEN 'view' THEN '/images/by-url' ELSE CASE WHEN event_id % 3 = 0 THEN '/nowhere' ELSE '/metrics' END END AS path,
  CASE event_id % 17 WHEN 3 THEN '404' WHEN 5 THEN '422' WHEN 7 THEN '429' WHEN 11 THEN '500' WHEN 13 THEN '304'
    WHEN 15 THEN '503' ELSE '200' END AS status,
  value / 20 AS latency_s,
  CASE event_id % 3 WHEN 0 THEN 'hit' WHEN 1 THEN 'miss' END AS cache_status,
  CASE user_id % 7 WHEN 0 THEN 'jpeg' WHEN 1 THEN 'png' WHEN 2 THEN 'avif' ELSE 'webp' END AS format
FROM {events}""",
    # requests with an Accept header
    "acc": """
SELECT event_id AS req_id, user_id % 2 = 0 AS has_alpha,
  CASE event_id % 5 WHEN 0 THEN 'jpeg' WHEN 1 THEN 'png' WHEN 2 THEN 'webp' WHEN 3 THEN 'bmp' ELSE 'svg' END AS input_type,
  CASE event_id % 13 WHEN 0 THEN 'image/avif,image/webp;q=0.8' WHEN 1 THEN 'image/webp, image/jpeg;q=0.9, */*;q=0.1'
    WHEN 2 THEN 'application/json' WHEN 3 THEN 'image/jpeg;q=2.0' WHEN 4 THEN 'IMAGE/JPEG' WHEN 5 THEN '' WHEN 6 THEN '*/*'
    WHEN 7 THEN 'image/*;q=0.5, image/png' WHEN 8 THEN 'image/jpeg;q=0.1, */*;q=0.9' WHEN 9 THEN 'image/png;q=0, image/jpeg;q=0'
    WHEN 10 THEN 'image/tiff, image/bmp;q=0.7' WHEN 11 THEN 'image/webp;q=abc, image/svg+xml;level=1;q=0.3' END AS accept,
  CASE event_id % 4 WHEN 0 THEN '*' WHEN 1 THEN 'W/"sha256-' || CAST(event_id AS VARCHAR(20)) || '"'
    WHEN 2 THEN '"a", "sha256-' || CAST(event_id AS VARCHAR(20)) || '"' END AS if_none_match
FROM {events}""",
    # remote URLs, friendly and hostile: an address in several forms, and others
    "urls": """
SELECT page_id, n, CASE page_id % 13
  WHEN 0 THEN 'http://' || CAST(n AS VARCHAR(20)) || '/x' WHEN 1 THEN 'http://0x' || lower(hex(n)) || '/x'
  WHEN 2 THEN 'http://' || dotted || '/x.png' WHEN 3 THEN 'https://' || dotted || './x'
  WHEN 4 THEN 'http://[::ffff:' || dotted || ']/x' WHEN 5 THEN 'http://' || a || '.' || CAST(n % 16777216 AS VARCHAR(20)) || ':80/x'
  WHEN 6 THEN 'http://' || a || '.0x' || hex(b) || '.' || CAST(n % 65536 AS VARCHAR(20)) || ':443'
  WHEN 7 THEN 'https://user:pw@example.com/x' WHEN 8 THEN 'ftp://' || dotted || '/x' WHEN 9 THEN 'https://example.com:8080/x'
  WHEN 10 THEN 'http://METADATA.google.internal./x' WHEN 11 THEN 'http://300.' || dotted || '/' ELSE url END AS url
FROM (
  SELECT *, CAST(floor(n / 16777216) AS VARCHAR(20)) AS a, CAST(floor(n / 65536) AS BIGINT) % 256 AS b,
    CAST(floor(n / 16777216) AS VARCHAR(20)) || '.' || CAST(CAST(floor(n / 65536) AS BIGINT) % 256 AS VARCHAR(20)) || '.'
      || CAST(CAST(floor(n / 256) AS BIGINT) % 256 AS VARCHAR(20)) || '.' || CAST(n % 256 AS VARCHAR(20)) AS dotted
  FROM (
    SELECT page_id, url, page_id * 37 % 512 + CASE page_id % 8 WHEN 0 THEN 2130706432 WHEN 1 THEN 167772160 WHEN 2 THEN 2851995648
      WHEN 3 THEN 134744064 WHEN 4 THEN 1681915904 WHEN 5 THEN 3405803520 WHEN 6 THEN 3758096384 ELSE 1681915648 END AS n
    FROM {pages}
  ) AS p
) AS p""",
    # forwarded-for chains
    "xff": """
SELECT event_id AS req_id, CASE WHEN event_id % 4 = 0 THEN '198.51.100.7' ELSE '10.0.0.1' END AS peer,
  CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '203.0.113.' || CAST(user_id % 200 AS VARCHAR(20)) || ', 10.0.0.2'
    WHEN 2 THEN '10.0.0.3,10.0.0.4' WHEN 3 THEN 'junk, 192.0.2.' || CAST(user_id % 100 AS VARCHAR(20)) || ' , 10.9.9.9'
    ELSE '8.8.8.8, 203.0.113.9' END AS xff,
  CASE WHEN event_id % 3 = 0 THEN '172.32.0.' || CAST(event_id % 256 AS VARCHAR(20)) END AS real_ip
FROM {events}""",
    # AVIF files in hexadecimal text: eight shapes of the tree of boxes
    "avif": """
SELECT req_id, w, h, shape, '00000010667479706176696600000000' || CASE shape
  WHEN 3 THEN mdat WHEN 4 THEN meta || '00' WHEN 5 THEN '000000016D6461740000000000000014' || '01020304' || meta
  WHEN 6 THEN meta || '000000006D646174FFFF' WHEN 7 THEN meta || '000000096D646174' ELSE meta || mdat END AS file
FROM (
  SELECT *, lpad(hex(CAST(12 + length(inner_) / 2 AS BIGINT)), 8, '0') || '6D65746100000000' || inner_ AS meta, '0000000C6D646174DEADBEEF' AS mdat
  FROM (
    SELECT *,
      lpad(hex(CAST(16 + length(props) / 2 AS BIGINT)), 8, '0') || '69707270' || lpad(hex(CAST(8 + length(props) / 2 AS BIGINT)), 8, '0') || '6970636F' || props
        || CASE WHEN shape = 2 THEN '0000001869726566000000000000000C6175786C00010001' ELSE '' END AS inner_
    FROM (
      SELECT *, '000000146973706500000000' || lpad(hex(w), 8, '0') || lpad(hex(h), 8, '0') || '000000146973706500000000' || '0000000100000001'
        || CASE shape WHEN 1 THEN '000000386175784300000000' || '75726E3A6D7065673A6D706567423A636963703A73797374656D733A617578696C696172793A616C70686100' ELSE '' END AS props
      FROM (SELECT p_partkey AS req_id, p_partkey % 8 AS shape, CAST(p_size AS BIGINT) * 31 + 1 AS w, p_partkey % 5000 + 1 AS h FROM {part}) AS a
    ) AS b
  ) AS c
) AS d""",
    # forwarded-for chains of both families; a is the third group of a hop, 40960 to 49151 of which are trusted
    "hops": """
SELECT *, CASE req_id % 5 WHEN 1 THEN six || ', ' || four WHEN 2 THEN four || ',' || six WHEN 3 THEN 'junk, ' || six || ' , 10.9.9.9'
    WHEN 4 THEN '::ffff:10.0.0.1, ' || four END AS xff,
  CASE req_id % 3 WHEN 0 THEN '2001:DB8:B000::1' WHEN 1 THEN '2606:4700::' || lower(hex(u)) END AS real_ip,
  CASE req_id % 4 WHEN 0 THEN '198.51.100.7' WHEN 1 THEN '10.0.0.1' WHEN 2 THEN 'fd00:1::' || lower(hex(u % 256)) ELSE 'fd00:2::1' END AS peer
FROM (
  SELECT event_id AS req_id, user_id AS u, event_id * 4099 % 65536 AS a, '192.0.2.' || CAST(user_id % 128 AS VARCHAR(20)) AS four,
    '2001:db8:' || lower(hex(event_id * 4099 % 65536)) || '::' || lower(hex(user_id)) AS six
  FROM {events}
) AS e""",
    # documents as stored objects
    "blob": """
SELECT doc_id, source || '/' || CAST(doc_id AS VARCHAR(20)) AS object_key, coalesce(text, '') AS body,
  CAST(length(coalesce(text, '')) AS BIGINT) AS size, doc_id * 37 % 5000 AS mtime, source,
  CASE doc_id % 5 WHEN 0 THEN NULL ELSE CAST(doc_id % 3 AS VARCHAR(20)) END AS version
FROM {documents}""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view, or a table if no view has that name."""
    tables = _Tables(lambda t: f"parquet.`{sf_dir}/{t}.parquet`")
    return spark.sql(VIEWS[name].format_map(tables)) if name in VIEWS else spark.read.parquet(f"{sf_dir}/{name}.parquet")


def duck(*names: str) -> str:
    """The head of a DuckDB query that defines the views: ``WITH req AS (...), ``."""
    plain = _Tables(lambda t: t)
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n].format_map(plain)})" for n in names)


class _Tables(dict):
    def __init__(self, of):
        super().__init__()
        self.of = of

    def __missing__(self, name):
        return self.of(name)
