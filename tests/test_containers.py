"""Metadata in files: round trips, broken files, and files with many segments."""

import struct
import zlib

import pytest
from pyspark.sql import functions as F

from imgrel.functions import containers as c
from imgrel.operators import encode

SCAN = bytes.fromhex("FFDA00040000") + b"scan\xff\x00data" + b"\xff\xd9tail"


def segment(code, body):
    return bytes([0xFF, code]) + struct.pack(">H", len(body) + 2) + body


def chunk(tag, body):
    return struct.pack(">I", len(body)) + tag + body + struct.pack(">I", zlib.crc32(tag + body))


def png(*chunks):
    head = chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0))
    return b"\x89PNG\r\n\x1a\n" + head + b"".join(chunks) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


def test_profile_segments_are_put_in_order_and_none_may_miss():
    pieces = [segment(0xE2, c.ICC + bytes([n, 3]) + bytes([n]) * 5) for n in (3, 1, 2)]
    whole = b"\xff\xd8" + b"".join(pieces) + SCAN
    assert c.metadata_of(whole, "jpeg")[1] == bytes([1] * 5 + [2] * 5 + [3] * 5)
    assert c.metadata_of(b"\xff\xd8" + b"".join(pieces[:2]) + SCAN, "jpeg")[1] is None


@pytest.mark.parametrize("data", [
    b"", b"\xff\xd8", b"\xff\xd8\xff", b"\xff\xd8\xff\xe1\x00\x01", b"\xff\xd8\xff\xe1\xff\xff", b"\xff\xd8" + SCAN[:8], b"\xff\xd8junk", b"GIF89a",
])
def test_broken_jpegs_have_no_parts(data):
    assert c.jpeg_parts(data) is None and c.metadata_of(data, "jpeg") == (None,) * 4


def test_all_metadata_of_a_png():
    itxt = chunk(b"iTXt", c.XMP_KEYWORD + b"\0\0\0en\0t\0<x/>")
    packed = chunk(b"iTXt", c.XMP_KEYWORD + b"\0\1\0\0\0" + zlib.compress(b"<y/>"))
    raw = chunk(b"zTXt", c.IPTC_KEYWORD + b"\0\0" + zlib.compress(b"\niptc\n       3\n1c02\n05\n"))
    icc = chunk(b"iCCP", b"name\0\0" + zlib.compress(b"profile"))
    file = png(chunk(b"eXIf", b"MM"), icc, itxt, raw)
    assert c.metadata_of(file, "png") == (b"MM", b"profile", b"<x/>", bytes.fromhex("1c0205"))
    assert c.metadata_of(png(packed), "png")[2] == b"<y/>"
    assert c.metadata_of(png(chunk(b"iCCP", b"name\0\0junk")), "png") == (None,) * 4


def test_iptc_is_found_behind_named_resources():
    other = c.RESOURCE + b"\x03\xed" + b"\x04name\0" + struct.pack(">I", 3) + b"abc\0"
    mine = c.RESOURCE + b"\x04\x04" + b"\0\0" + struct.pack(">I", 2) + b"hi"
    assert c.iptc_of(c.PHOTOSHOP + other + mine) == b"hi"
    assert c.iptc_of(c.PHOTOSHOP + mine[:-1]) is None


def test_broken_webps_are_not_touched():
    assert c.with_webp_metadata(b"RIFF\0\0\0\0WEBPVP8 \xff\xff\xff\xff", b"i", None, None) is None
    assert c.with_webp_metadata(b"RIFF\0\0\0\0WEBPJUNK\0\0\0\0", b"i", None, None) is None
    assert c.with_webp_metadata(b"RIFF\0\0\0\0WEBPJUNK\0\0\0\0", None, None, None) == b"RIFF\0\0\0\0WEBPJUNK\0\0\0\0"


def test_a_jpeg_of_thousands_of_segments_and_nulls_go_through_spark(spark):
    long = b"\xff\xd8" + b"".join(segment(0xE1, c.EXIF + b"%d" % k) + b"\xff" * (k % 5) for k in range(3000)) + SCAN
    rows = [(1, long, "jpeg"), (2, None, "jpeg"), (3, b"x", None), (4, b"BM", "bmp"), (5, b"\xff\xd8", "jpeg")]
    df = spark.createDataFrame(rows, "id long, content binary, kind string").withColumn("parts", c.parts("content", "kind"))
    out = {r["id"]: r for r in df.select(
        "id", F.size("parts").alias("n"), c.rewrite_jpeg(F.col("content"), F.col("parts"), F.lit("strip_all")).alias("bare"),
        c.metadata("content", "kind").alias("m")).collect()}
    assert out[1]["n"] == 3002 and bytes(out[1]["bare"]) == b"\xff\xd8" + SCAN and bytes(out[1]["m"]["exif"]) == b"0"
    for k in (2, 3, 4, 5):
        assert out[k]["bare"] is None and out[k]["m"]["exif"] is None


def test_what_is_put_in_is_read_again(spark):
    vp8 = b"VP8 " + struct.pack("<I", 10) + bytes.fromhex("0000009D012A0A001400")
    files = {"jpeg": b"\xff\xd8" + SCAN, "png": png(), "webp": b"RIFF" + struct.pack("<I", 4 + len(vp8)) + b"WEBP" + vp8, "bmp": b"BM"}
    meta = F.struct(*(F.lit(v).cast("binary").alias(n) for n, v in (("exif", "e"), ("icc", "icc"), ("xmp", "<x/>"), ("iptc", "rec"))))
    df = spark.createDataFrame([(k, v) for k, v in files.items()], "kind string, content binary")
    made = df.select("kind", encode.inject(F.col("content"), F.col("kind"), meta).alias("r"))
    read = made.select("kind", "r.dropped", c.metadata("r.content", "kind").alias("m"))
    found = {r["kind"]: (r["dropped"], tuple(None if v is None else bytes(v) for v in r["m"])) for r in read.collect()}
    assert found["jpeg"] == ([], (None, None, b"<x/>", b"rec"))
    assert found["png"] == (["IPTC"], (None, None, b"<x/>", None))
    assert found["webp"] == (["IPTC"], (b"e", b"icc", b"<x/>", None))
    assert found["bmp"][0] == ["XMP", "IPTC"]


def test_a_payload_too_long_for_a_segment_is_reported(spark):
    meta = F.struct(*(F.lit(v).cast("binary").alias(n) for n, v in (("exif", None), ("icc", None), ("xmp", "x" * 70000), ("iptc", "y" * 70000))))
    df = spark.createDataFrame([("jpeg", b"\xff\xd8" + SCAN)], "kind string, content binary")
    r = df.select(encode.inject(F.col("content"), F.col("kind"), meta).alias("r")).first()["r"]
    assert r["dropped"] == ["XMP", "IPTC"] and bytes(r["content"]) == b"\xff\xd8" + SCAN
