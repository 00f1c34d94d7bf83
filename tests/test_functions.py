"""Single functions against other implementations and stated cases."""

import hashlib
import hmac
import ipaddress
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from imgrel.functions import media, negotiate, parse, signing, svg, urls
from imgrel.functions import tiff as tiff_functions
from imgrel.operators import cache, limits, metrics, rasters


def values(spark, column, texts, name="t"):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], f"k int, {name} string")
    return [r.v for r in rows.select("k", column(F.col(name)).alias("v")).orderBy("k").collect()]


def test_crop_texts(spark):
    found = values(spark, parse.crop, ["1,2,3,4", "+1,2,3,4", "1,2,3", "a,2,3,4", "1,2,0,4", " 1,2,3,4", "0,0,4294967295,1", "0,0,4294967296,1", ""])
    assert [r.error is None for r in found] == [True, True, False, False, False, False, True, False, False]
    assert found[0].x == 1 and found[0].height == 4
    assert found[4].error == "crop width and height must be greater than zero"


def test_target_quality_texts(spark):
    found = values(spark, parse.target_quality, ["ssim:0.98", "SSIM:.5", "psnr:4e1", "psnr: 4", "ssim", "x:1", "ssim:1.5f"])
    assert [r.error is None for r in found] == [True, True, True, False, False, False, False]
    assert found[2].value == pytest.approx(40.0)


def test_hmac_of_short_and_long_keys(spark):
    keys = ["", "k", "a" * 64, "b" * 65, "é" * 40]
    found = values(spark, lambda k: signing.hmac_sha256(k, F.lit("message é")), keys)
    assert found == [hmac.new(k.encode(), "message é".encode(), hashlib.sha256).hexdigest() for k in keys]


def test_denied_addresses(spark):
    texts = ["10.0.0.1", "8.8.8.8", "172.31.255.255", "172.32.0.0", "100.64.0.1", "100.128.0.1", "198.19.0.1", "198.20.0.1", "224.0.0.1", "0.0.0.0", "256.1.1.1", "01.2.3.4", "x"]
    denied = {"10.0.0.1", "172.31.255.255", "100.64.0.1", "198.19.0.1", "224.0.0.1", "0.0.0.0"}
    assert values(spark, urls.is_denied, texts) == [t in denied for t in texts]
    assert int(ipaddress.ip_address("8.8.8.8")) == values(spark, urls.address, ["8.8.8.8"])[0]


def test_negotiation_takes_the_largest_weight_not_the_most_specific(spark):
    rows = spark.createDataFrame([
        ("image/jpeg;q=0.1, */*;q=0.9", "jpeg", False), (None, "jpeg", False), ("image/png;q=0", "png", True), ("text/html", "png", True), ("*/*", "bmp", False),
        ("image/webp;q=1;q=0.2,image/png;q=0.3", "png", False),
    ], "accept string, input_type string, has_alpha boolean")
    found = [(r.chosen, r.status) for r in negotiate.negotiate(rows).collect()]
    assert found == [("avif", 200), (None, 200), (None, 406), (None, 406), ("bmp", 200), ("png", 200)]


def test_entity_tags(spark):
    found = values(spark, lambda t: negotiate.not_modified(t, F.lit('"sha256-x"')), ['"sha256-x"', 'W/"sha256-x"', "*", '"a", "sha256-x"', '"a"', "", None])
    assert found == [True, True, True, True, False, False, False]


def test_sniff_of_signatures(spark):
    cases = {"89504E470D0A1A0A": "png", "FFD8FF00": "jpeg", "524946460000000057454250": "webp", "000000186674797061766966": "avif", "424D" + "00" * 24: "bmp",
             "424D00": None, "49492A00": "tiff", "3C737667203E": "svg", "": None, "00": None}
    assert values(spark, lambda t: media.sniff(F.unhex(t)), list(cases)) == list(cases.values())


def headers(spark, files):
    df = spark.createDataFrame([(k, bytearray(f)) for k, f in enumerate(files)], "k int, content binary")
    rows = df.select("k", media.header(F.col("content")).alias("h")).orderBy("k").collect()
    return [(r.h.media_type, r.h.width, r.h.height, r.h.has_alpha) for r in rows]


def riff(*parts):
    body = b"".join(tag + len(data).to_bytes(4, "little") + data + b"\0" * (len(data) % 2) for tag, data in parts)
    return b"RIFF" + (len(body) + 4).to_bytes(4, "little") + b"WEBP" + body


def test_webp_of_all_chunks_and_tiff_have_sizes(spark):
    lossy = b"\x10\x02\x00\x9d\x01\x2a" + (640 | 1 << 14).to_bytes(2, "little") + (427 | 2 << 14).to_bytes(2, "little")
    bits = lambda alpha: b"\x2f" + (16383 | 99 << 14 | alpha << 28).to_bytes(4, "little")
    extended = b"\x10\0\0\0" + (69999).to_bytes(3, "little") + (4).to_bytes(3, "little")
    tag = lambda number, kind, value: number.to_bytes(2, "big") + kind.to_bytes(2, "big") + b"\0\0\0\1" + value
    directory = tag(256, 4, (70000).to_bytes(4, "big")) + tag(257, 3, b"\0\x09\0\0") + tag(262, 3, b"\0\2\0\0") + tag(277, 3, b"\0\4\0\0")
    files = [
        riff((b"VP8 ", lossy + b"data")), riff((b"VP8L", bits(1))), riff((b"VP8L", bits(0))), riff((b"VP8X", extended), (b"VP8 ", lossy)),
        riff(*[(b"JUNK", b"odd")] * 100, (b"VP8L", bits(1))), riff((b"VP8 ", lossy.replace(b"\x9d", b"\x9c"))), riff((b"VP8L", bits(1)))[:-2], riff((b"JUNK", b"")),
        b"MM\0\x2a\0\0\0\x08\0\4" + directory + b"\0\0\0\0", b"II\x2a\0",
    ]
    assert headers(spark, files) == [
        ("webp", 640, 427, False), ("webp", 16384, 100, True), ("webp", 16384, 100, False), ("webp", 70000, 5, True),
        ("webp", 16384, 100, True), ("webp", None, None, None), ("webp", None, None, None), ("webp", None, None, None),
        ("tiff", 70000, 9, True), ("tiff", None, None, None),
    ]


def test_jpeg_frame_after_many_segments_and_fill_bytes(spark):
    segment = lambda marker, data: bytes([0xFF, marker]) + (len(data) + 2).to_bytes(2, "big") + data
    frame = segment(0xC2, b"\x08" + (427).to_bytes(2, "big") + (640).to_bytes(2, "big") + b"\3" + b"\0" * 9)
    icc = segment(0xE2, b"ICC_PROFILE\0" + b"\xff" * 300)
    files = [
        b"\xff\xd8" + icc * 200 + frame, b"\xff\xd8" + segment(0xFE, b"") * 3000 + frame, b"\xff\xd8" + b"\xff" * 500 + frame,
        b"\xff\xd8" + (b"\xff" * 3 + icc) * 70 + b"\xff\x01\xff\xd0" + b"\xff" * 5 + frame + b"\xff\xd9",
        b"\xff\xd8" + segment(0xC4, b"table") + frame, b"\xff\xd8" + icc * 80 + b"\xff\xd9" + frame, b"\xff\xd8" + icc + b"\xff\xda" + frame,
        b"\xff\xd8" + frame[:-1], b"\xff\xd8\xff" + b"\0\0\0" + frame, b"\xff\xd8\xff",
    ]
    good, none = ("jpeg", 640, 427, False), ("jpeg", None, None, False)
    assert headers(spark, files) == [good] * 5 + [none] * 5


def test_svg_cleaning(spark):
    found = values(spark, lambda t: svg.sanitize(t.cast("binary"))["clean"], ['<svg><script>x</script><a href="#b" onclick="y"/></svg>', '<svg><a href="javascript:x"/></svg>', "<svg><style>a{fill:url(http://e)}</style></svg>", None])
    assert found == ['<svg><a href="#b"/></svg>', "<svg><a/></svg>", "<svg><style>a{fill:url()}</style></svg>", None]


def test_svg_cleaning_of_odd_images():
    clean = lambda text: svg.cleaned(text if isinstance(text, bytes) else text.encode())
    head = '<!DOCTYPE svg [<!ENTITY e "<script>x</script><b>y</b>">]>'
    assert clean(head + "<svg>&e;</svg>") == ("<!DOCTYPE svg><svg><b>y</b></svg>", None)
    assert clean("<svg><style>@im<x/>port url(e);a{}</style></svg>") == ("<svg><style>a{}</style></svg>", None)
    assert clean('<?xml version="1.0" encoding="ISO-8859-1"?><svg a="&#10;&quot;">\u00e9</svg>') == ('<?xml version="1.0" encoding="ISO-8859-1"?><svg a="&#10;&quot;">\u00e9</svg>', None)
    assert clean(b"<svg>\xff</svg>")[1].startswith("DecodeFailed") and clean("")[1].startswith("DecodeFailed")
    deep = "<g>" * svg.MAX_DEPTH + "</g>" * svg.MAX_DEPTH
    assert clean(deep)[0] == deep and clean(f"<svg>{deep}</svg>")[1].startswith("LimitExceeded")
    many = "<svg>" + "<a/>" * (svg.MAX_ELEMENTS - 1)
    assert clean(many + "</svg>")[1] is None and clean(many + "<b/></svg>")[1].startswith("LimitExceeded")
    long = "<svg><style>" + "a{b:url(c)}" * 20_000 + "</style></svg>"
    assert clean(long)[0] == long.replace("url(c)", "url()")


def test_eviction_removes_the_oldest_until_the_rest_fits(spark):
    entries = spark.createDataFrame([("a", 100, 1), ("b", 100, 2), ("c", 100, 3)], "key string, size long, mtime long")
    gone = lambda most: {r.key for r in cache.evict(entries, most, parts=2).where("evicted").collect()}
    assert gone(200) == {"a"} and gone(99) == {"a", "b", "c"} and gone(300) == set() and gone(0) == set()


def test_bucket_refills_and_is_kept_by_key(spark):
    events = spark.createDataFrame([(1, k, 0.0) for k in range(6)] + [(2, 9, 0.0), (1, 7, 1.0), (1, 8, 1.0)], "key long, event_id long, at double")
    found = {(r.key, r.event_id): r.admitted for r in limits.token_bucket(events, rate=1.0, burst=5.0).collect()}
    assert [found[1, k] for k in range(6)] == [True] * 5 + [False]
    assert found[2, 9] and found[1, 7] and not found[1, 8]


def test_hysteresis_holds_its_state_between_the_bounds(spark):
    samples = spark.createDataFrame([(1, k, v) for k, v in enumerate([80, 95, 89, 79, 95, 100, 91, 89])], "probe int, at int, value long")
    rows = limits.hysteresis(samples, threshold=90, margin=0.1).orderBy("at").collect()
    assert [r.ok for r in rows] == [True, False, False, True, False, False, False, False]
    assert [r.recovering for r in rows] == [False, False, True, False, False, False, False, True]


def test_quantile_in_the_open_bucket_is_the_last_bound(spark):
    log = spark.createDataFrame([("a", 100.0)] * 3 + [("b", 0.05)] * 4, "k string, v double")
    found = {r.k: r["quantile"] for r in metrics.quantile(log, "k", "v", 0.5).collect()}
    assert found["a"] == 30.0 and found["b"] == pytest.approx(0.0375)


def test_weights_keep_a_flat_image_flat():
    for target in (1, 3, 8, 20):
        flat = np.full((8, 5, 4), 77, np.uint8)
        assert (rasters.resized(flat, target, 2 * target) == 77).all() and (rasters.blurred(flat, target / 2) == 77).all()


def test_png_of_every_filter_and_kind_is_read():
    rng = np.random.default_rng(0)
    image = rng.integers(0, 256, (7, 5, 4), dtype=np.uint8)
    opaque = image.copy()
    opaque[..., 3] = 255
    for kind in range(5):
        for pixels in (image, opaque, image[:1], image[:, :1]):
            assert (rasters.png_pixels(rasters.png_bytes(pixels, 9, kind)) == pixels).all()
    for pixels in (image, opaque, image[:1], image[:, :1]):
        assert (rasters.bmp_pixels(rasters.bmp_bytes(pixels)) == pixels).all()
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + bytes(4)
    made = lambda colour, rows, extra=b"": rasters.PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", 2, 2, 8, colour, 0, 0, 0)) + extra + chunk(b"IDAT", zlib.compress(rows))
    assert rasters.png_pixels(made(0, b"\0\1\2\0\3\4") + bytes(9)).tolist() == [[[1, 1, 1, 255], [2, 2, 2, 255]], [[3, 3, 3, 255], [4, 4, 4, 255]]]
    palette = chunk(b"PLTE", bytes(range(9))) + chunk(b"tRNS", b"\x07")
    assert rasters.png_pixels(made(3, b"\0\0\1\0\2\0", palette)).tolist() == [[[0, 1, 2, 7], [3, 4, 5, 255]], [[6, 7, 8, 255], [0, 1, 2, 7]]]
    for broken in (b"", rasters.PNG, made(0, b"\0\1"), made(0, b"\x09\1\2\0\3\4"), made(7, b""), rasters.png_bytes(image)[:60]):
        with pytest.raises((ValueError, struct.error)):
            rasters.png_pixels(broken)


def test_images_of_other_sizes_and_nulls(spark):
    rows = [(1, 2, 1, bytes(range(8)), "x"), (2, None, None, None, "y"), (3, 1, 3, bytes(12), None)]
    df = spark.createDataFrame(rows, "image_id long, width int, height int, data binary, note string")
    found = {r.image_id: (r.width, r.height, bytes(r.data or b""), r.note) for r in rasters.map_images(df, lambda p, row: rasters.rotated(p, 90)).collect()}
    assert found == {1: (1, 2, bytes(range(8)), "x"), 2: (None, None, b"", "y"), 3: (3, 1, bytes(12), None)}
    assert rasters.map_images(df.limit(0), lambda p, row: p).count() == 0
    files = spark.createDataFrame([(1, "png", b"junk"), (2, None, None), (3, "jpeg", b"x")], "image_id long, media_type string, content binary")
    assert [r.error for r in rasters.decode(files).orderBy("image_id").collect()] == ["DecodeFailed", "CapabilityMissing", "CapabilityMissing"]


def test_hosts_are_read_as_browsers_do(spark):
    refused = ["http://[::1]/", "http://[fe80::1]:80/", "http://2130706433/", "http://0x7f.1/", "http://127.0.0.1./", "http://127.1", "http://0177.0.0.01/", "HTTP://0X7F000001/",
               "http://%31%32%37.0.0.1/", "http:\\\\127.0.0.1\\x", "http:127.0.0.1", " http://10.0.0.1 ", "http://127\n.0.0.1/", "http://\uff11\uff12\uff17.0.0.1/", "http://127\u30020\u30020\u30021/",
               "http://[::ffff:10.0.0.1]/", "http://metadata.google.internal./x", "http://0/", "http://0x/", "https://example.com:81/"]
    bad = ["http://", "http://a@b/", "ftp://x/", "http://1.2.3.4.5/", "http://256.1.1.1/", "http://[::1/", "http://[zz]/", "http://0x100000000/", "http://a b/", "http://a%00b/", "http://x:99999/", "http://09/", "x", "http://99999999999999999999/"]
    good = ["http://8.8.8.8/", "https://example.com", "http://[2606:4700::1111]/", "http://134744072/", "http://1.2.3.4a/", "https://caf\u00e9.example/", "http://example.com:80/a@b", "http://127.0.0.1.example/"]
    assert values(spark, urls.url_status, refused) == [403] * len(refused)
    assert values(spark, urls.url_status, bad) == [400] * len(bad)
    assert values(spark, urls.url_status, good) == [200] * len(good)


def test_vector_images_are_recognised_behind_any_prologue(spark):
    yes = ["<svg>", "\ufeff <svg ", "<?xml version='1.0'?>\n<svg\t", "<?xml?><!DOCTYPE svg>\n<!-- a --><!-- b -->\n<svg>", "<!--c-->" * 20_000 + "<svg>", " " * 100_000 + "<svg>"]
    no = ["<SVG>", "<?XML ?><svg>", "<!doctype svg><svg>", "", "<svgx>", "x<svg>", "<!-- <svg>", "<?xml <svg>", "<!--c-->" * 20_000, "<html><svg>", "<!--a--> x <svg>", " " * 100_000]
    assert values(spark, media.is_svg, yes) == [True] * len(yes) and values(spark, media.is_svg, no) == [False] * len(no)
    assert values(spark, lambda t: media.sniff(t.cast("binary")), yes) == ["svg"] * len(yes)
    assert values(spark, lambda t: media.sniff(t.cast("binary")), no) == [None] * len(no)
    box = lambda major, *brands: (16 + 4 * len(brands)).to_bytes(4).hex() + "66747970" + (major + "\0\0\0\0" + "".join(brands)).encode().hex()
    found = values(spark, lambda t: media.sniff(F.unhex(t)), [box("avif"), box("mif1", "miaf", "avif"), box("mif1", "heic"), box("mif1", "xavi", "fxxx"), "3C737667FF3E"])
    assert found == ["avif", "avif", None, None, None]


def test_tiff_directories(spark):
    """Both orders, cut files, a directory out of reach, and each tag's first entry; every entry is read once."""
    def tiff(order, entries, first=8, count=None):
        body = b"".join(struct.pack(order + "HHI", tag, kind, 1) + (struct.pack(order + "HH", v, 0) if kind == 3 else struct.pack(order + "I", v)) for tag, kind, v in entries)
        start = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", first)
        return start + struct.pack(order + "H", len(entries) if count is None else count) + body

    size = [(256, 4, 70_000), (257, 3, 9)]
    files = [
        tiff("<", [(1, 3, 5), *size, (262, 3, 2), (277, 3, 4)]), tiff(">", [*size, (256, 3, 1), (262, 3, 1), (277, 3, 2)]), tiff("<", size, first=1 << 31),
        tiff(">", size, first=(1 << 32) - 1), tiff(">", size)[:-1], tiff(">", size)[:-4], tiff("<", size, count=65535), tiff("<", []), b"II*\0", b"",
    ]
    df = spark.createDataFrame([(k, bytearray(f)) for k, f in enumerate(files)] + [(len(files), None)], "k int, content binary").select("k", tiff_functions.header(F.col("content")).alias("h"))
    found = [tuple(r.h) for r in df.orderBy("k").collect()]
    nothing = (None, None, False)
    assert found == [(70_000, 9, True), (70_000, 9, True), nothing, nothing, (70_000, 9, False), (70_000, None, False), (70_000, 9, False), *[nothing] * 4]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("conv(") < 50
