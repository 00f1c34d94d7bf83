"""Media types, limits, errors, and recognising a format by its first bytes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tiff

# Name, MIME type, lossy, optimisable, lossy-optimisable, carries ICC, raster,
# default quality, default SSIM target, default background is opaque white.
MEDIA_TYPES = [
    ("jpeg", "image/jpeg", True, True, True, True, True, 76, 0.985, True),
    ("png", "image/png", False, True, False, True, True, 80, None, False),
    ("webp", "image/webp", True, True, True, True, True, 75, 0.985, False),
    ("avif", "image/avif", True, True, True, False, True, 68, 0.99, True),
    ("svg", "image/svg+xml", False, False, False, False, False, None, None, False),
    ("bmp", "image/bmp", False, False, False, False, True, 80, None, True),
    ("tiff", "image/tiff", False, False, False, False, True, 80, None, False),
]
MEDIA_SCHEMA = (
    "name string, mime string, lossy boolean, optimizable boolean, lossy_optimizable boolean, icc boolean, "
    "raster boolean, default_quality int, default_ssim double, white boolean"
)

# Error kind, HTTP status, exit code of the command line, metric label.
ERRORS = [
    ("InvalidInput", 400, 3, "invalid_input"),
    ("InvalidOptions", 400, 1, "invalid_options"),
    ("UnsupportedInput", 415, 4, "unsupported_input_format"),
    ("UnsupportedOutput", 415, 4, "unsupported_output_format"),
    ("DecodeFailed", 400, 4, "decode_failed"),
    ("EncodeFailed", 500, 4, "encode_failed"),
    ("CapabilityMissing", 501, 4, "capability_missing"),
    ("LimitExceeded", 413, 4, "limit_exceeded"),
]

# Fixed values.
MAX_OUTPUT_PIXELS = 67_108_864
MAX_INPUT_PIXELS = 100_000_000
MAX_WATERMARK_PIXELS = 4_000_000
MAX_SOURCE_BYTES = 100 * 1024 * 1024
MAX_KEY_BYTES = 1024


def media_types(spark: SparkSession) -> DataFrame:
    """The seven media types: a table of fixed size, so joins to it may broadcast it."""
    return spark.createDataFrame(MEDIA_TYPES, MEDIA_SCHEMA)


def media_flag(name: Column, flag: str) -> Column:
    """A fact about a media type by name; null for an unknown one."""
    at = [x.split()[0] for x in MEDIA_SCHEMA.split(", ")].index(flag)
    out = F.lit(None)
    for row in MEDIA_TYPES:
        out = F.when(name == row[0], F.lit(row[at])).otherwise(out)
    return out


def parse_media_type(text: Column) -> Column:
    """Case-sensitive names, with the aliases jpg and tif; null if unknown."""
    name = F.when(text == "jpg", "jpeg").when(text == "tif", "tiff").otherwise(text)
    return F.when(name.isin([row[0] for row in MEDIA_TYPES]), name)


def u(content: Column, at: int, width: int, little: bool = False) -> Column:
    """An unsigned integer of ``width`` bytes at byte ``at`` (from 0)."""
    byte = lambda k: F.conv(F.hex(F.substring(content, at + k + 1, 1)), 16, 10).cast("long")
    order = range(width) if little else range(width - 1, -1, -1)
    total = F.lit(0).cast("long")
    for power, k in enumerate(order):
        total = total + byte(k) * (1 << (8 * power))
    return total


def starts(content: Column, hex_bytes: str, at: int = 0) -> Column:
    return F.hex(F.substring(content, at + 1, len(hex_bytes) // 2)) == hex_bytes


def sniff(content: Column) -> Column:
    """The media type by signature, in the fixed order of probes; null if none matches.

    Only what no binary signature names is looked at as text, in an array of
    at most one element, so that other files are not decoded.
    """
    brand = F.hex(F.substring(content, 9, 4)).isin("61766966", "61766973")
    known = (
        F.when(starts(content, "89504E470D0A1A0A"), "png")
        .when(starts(content, "FFD8FF"), "jpeg")
        .when(starts(content, "52494646") & starts(content, "57454250", 8), "webp")
        .when(starts(content, "66747970", 4) & (brand | _compatible_brand(content)), "avif")
        .when(starts(content, "424D") & (F.octet_length(content) >= 26), "bmp")
        .when(starts(content, "49492A00") | starts(content, "4D4D002A"), "tiff")
    )
    # the first sign that is neither white space nor of a byte order mark
    marked = F.hex(F.substring(content, 1, 64)).rlike("^(?:EFBBBF)?(?:09|0A|0B|0C|0D|20|C2A0|C285)*+(?:3C|$)")
    texts = F.when(known.isNull() & marked & F.is_valid_utf8(content.cast("string")), F.array(content.cast("string")))
    svg = F.exists(texts, lambda t: is_svg(t))
    return F.coalesce(known, F.when(svg, F.lit("svg")))


def _compatible_brand(content: Column) -> Column:
    """Whether the first box lists avif or avis among the brands that it is compatible with."""
    size = F.conv(F.hex(F.substring(content, 1, 4)), 16, 10).cast("long")
    last = F.least(size, F.octet_length(content).cast("long")).cast("int") - 3
    places = F.when(last >= 17, F.sequence(F.lit(17), last, F.lit(4)))
    return F.coalesce(F.exists(places, lambda k: F.hex(F.substr(content, k, F.lit(4))).isin("61766966", "61766973")), F.lit(False))


def is_svg(text: Column) -> Column:
    """A BOM, a declaration, a doctype and comments may stand before ``<svg`` and a separator, in this case of letters alone.

    What stands before is replaced away one kind after another, so that no
    pattern repeats a group: however many comments there are, no stack grows.
    """
    head = F.regexp_replace(F.regexp_replace(text, r"^\x{FEFF}", ""), r"^\s++", "")
    head = F.regexp_replace(F.when(F.startswith(head, F.lit("<?xml")), _after(head, "?>")).otherwise(head), r"^\s++", "")
    head = F.regexp_replace(head, r"^<!DOCTYPE[^>]*+>\s*+", "")
    # comments: all up to the first opening that is none
    rest = F.split(head, "-->", -1)
    plain = F.filter(rest, lambda piece: ~F.regexp_replace(piece, r"^\s++", "").startswith("<!--"))
    first = F.regexp_replace(F.coalesce(F.get(plain, 0), F.lit("")), r"^\s++", "")
    return F.coalesce(first.rlike(r"^<svg[ \t\n\r>]"), F.lit(False))


def _after(text: Column, mark: str) -> Column:
    """What follows the first ``mark``; nothing if it is not there."""
    at = F.instr(text, mark)
    return F.when(at > 0, F.substr(text, at + len(mark))).otherwise(F.lit(""))


def _at(content: Column, pos: Column, width: int, little: bool = False) -> Column:
    """As ``u``, at a byte that is a column."""
    text = F.hex(F.substr(content, pos.cast("int") + 1, F.lit(width)))
    if little:
        text = F.concat(*(F.substring(text, 2 * k + 1, 2) for k in range(width - 1, -1, -1)))
    return F.conv(text, 16, 10).cast("long")


def _webp_chunk(content: Column, walked: Column) -> Column:
    """Offset of the first chunk that tells the size, past any others; null if there is none. Only ``walked`` rows are read."""
    n = F.octet_length(content).cast("long")

    def step(acc: Column, _: Column) -> Column:
        pos = acc["pos"]
        size = _at(content, pos + 4, 4, little=True)
        tag = F.hex(F.substr(content, pos.cast("int") + 1, F.lit(4)))
        ended = (pos + 8 > n) | (pos + 8 + size > n)
        found = tag.isin("56503858", "56503820", "5650384C")
        return F.when(acc["over"], acc).otherwise(F.struct(
            (pos + 8 + size + size % 2).alias("pos"), F.when(found & ~ended, pos).alias("found"),
            F.coalesce(ended | found, F.lit(True)).alias("over"),
        ))

    return _walk(content, 12, step, walked)


def _walk(content: Column, first: int, step: Callable[[Column, Column], Column], walked: Column) -> Column:
    """``found`` after as many steps on ``(pos, found, over)`` as there are bytes, or until it is over.

    A step moves by a byte at least.  Steps are dealt into blocks of the square
    root of their number, so that what is left when it is over costs little.
    """
    start = F.struct(
        F.lit(first).cast("long").alias("pos"), F.lit(None).cast("long").alias("found"),
        F.coalesce(~walked, F.lit(True)).alias("over"),
    )
    steps = F.sequence(F.lit(1), F.ceil(F.sqrt(F.octet_length(content) + 1)).cast("int"))
    none = F.array().cast("array<int>")
    block = lambda acc, _: F.aggregate(F.when(acc["over"], none).otherwise(steps), acc, step)
    return F.aggregate(F.when(walked, steps).otherwise(none), start, block, lambda acc: acc["found"])


def _jpeg_frame(content: Column, walked: Column) -> Column:
    """Offset of the first start-of-frame marker, by walking all segments before it; null if there is none."""
    n = F.octet_length(content).cast("long")

    def step(acc: Column, _: Column) -> Column:
        pos = acc["pos"]
        marker, length = _at(content, pos + 1, 1), F.coalesce(_at(content, pos + 2, 2), F.lit(0))
        # any number of fill bytes may stand before a marker; restarts and TEM have no length
        fill, alone = marker == 0xFF, marker.between(0xD0, 0xD7) | (marker == 0x01)
        ended = (pos + 2 > n) | (_at(content, pos, 1) != 0xFF) | marker.isin(0xD9, 0xDA)
        cut = ~fill & ~alone & ((length < 2) | (pos + 2 + length > n))
        frame = marker.between(0xC0, 0xCF) & ~marker.isin(0xC4, 0xC8, 0xCC)
        return F.when(acc["over"], acc).otherwise(F.struct(
            F.when(fill, pos + 1).when(alone, pos + 2).otherwise(pos + 2 + length).alias("pos"),
            F.when(frame & ~ended & ~cut & (length >= 7), pos).alias("found"),
            F.coalesce(ended | cut | frame, F.lit(True)).alias("over"),
        ))

    return _walk(content, 2, step, walked)


def header(content: Column) -> Column:
    """``(media_type, width, height, has_alpha)`` from the header alone; null sizes where it names none."""

    def walked(file: Column, kind: Column) -> Column:
        places = F.struct(
            F.when(kind == "webp", _webp_chunk(file, F.lit(True))).alias("chunk"), F.when(kind == "jpeg", _jpeg_frame(file, F.lit(True))).alias("frame"),
            F.when(kind == "tiff", tiff.header(file)).alias("directory"),
        )
        return _let(places, lambda at: _header(file, kind, at["chunk"], at["frame"], at["directory"]))

    return _let(content, lambda file: _let(sniff(file), lambda kind: walked(file, kind)))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _header(content: Column, kind: Column, chunk: Column, frame: Column, directory: Column) -> Column:
    be2 = lambda pos: F.conv(F.hex(F.substr(content, pos + 1, F.lit(2))), 16, 10).cast("long")
    signed = u(content, 22, 4, little=True)
    colour = u(content, 25, 1)
    le = lambda at, width: _at(content, chunk + at, width, little=True)
    tag, size, bits = le(0, 4), le(4, 4), le(9, 4)
    # VP8X, VP8 with its start code, VP8L with its signature
    extended = (tag == 0x58385056) & (size >= 10)
    lossy = (tag == 0x20385056) & (size >= 10) & (le(11, 3) == 0x2A019D)
    lossless = (tag == 0x4C385056) & (size >= 5) & (le(8, 1) == 0x2F)
    low = lambda number: number.bitwiseAND(F.lit(0x3FFF))
    width = (
        F.when(kind == "png", u(content, 16, 4)).when(kind == "bmp", u(content, 18, 4, little=True))
        .when(extended, le(12, 3) + 1).when(lossy, low(le(14, 2))).when(lossless, low(bits) + 1)
        .when(kind == "jpeg", be2(frame + 7)).when(kind == "tiff", directory["width"])
    )
    # a negative BMP height means that rows run from the top down
    height = (
        F.when(kind == "png", u(content, 20, 4))
        .when(kind == "bmp", F.when(signed >= 1 << 31, (1 << 32) - signed).otherwise(signed))
        .when(extended, le(15, 3) + 1).when(lossy, low(le(16, 2))).when(lossless, low(F.shiftright(bits, 14)) + 1)
        .when(kind == "jpeg", be2(frame + 5)).when(kind == "tiff", directory["height"])
    )
    alpha = (
        F.when(kind == "png", F.when(colour.isin(4, 6), True).when(colour.isin(0, 2, 3), False))
        .when(kind == "bmp", u(content, 28, 2, little=True) == 32)
        .when(extended, le(8, 1).bitwiseAND(F.lit(16)) > 0).when(lossy, False)
        .when(lossless, F.shiftright(bits, 28).bitwiseAND(F.lit(1)) > 0)
        .when(kind == "jpeg", False).when(kind == "svg", True)
        .when((kind == "tiff") & directory["width"].isNotNull(), directory["has_alpha"])
    )
    return F.struct(kind.alias("media_type"), width.alias("width"), height.alias("height"), alias_bool(alpha))


def alias_bool(alpha: Column) -> Column:
    return alpha.cast("boolean").alias("has_alpha")
