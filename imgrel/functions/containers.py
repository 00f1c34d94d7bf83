"""Segments of JPEG, chunks of PNG and WebP, and the metadata that they carry.

A file is taken apart in an Arrow batch, in time linear in its size; what is
put together again is chosen and joined by built-in functions where the parts
need not be read.
"""

from __future__ import annotations

import re
import struct
import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What the payloads of metadata segments start with, and the text chunks that hold XMP and IPTC.
EXIF = b"Exif\0\0"
ICC = b"ICC_PROFILE\0"
XMP = b"http://ns.adobe.com/xap/1.0/\0"
PHOTOSHOP = b"Photoshop 3.0\0"
RESOURCE = b"8BIM"
IPTC_RESOURCE = 0x0404
XMP_KEYWORD = b"XML:com.adobe.xmp"
IPTC_KEYWORD = b"Raw profile type iptc"

PART = ("tag", "start", "size", "whole_start", "whole_size")
_PART = T.ArrayType(T.StructType([T.StructField(n, T.IntegerType() if n != "tag" else T.StringType()) for n in PART]))
_METADATA = T.StructType([T.StructField(n, T.BinaryType()) for n in ("exif", "icc", "xmp", "iptc")])
_MARKER = re.compile(rb"\xff+([^\xff])", re.DOTALL)


def jpeg_parts(data: bytes) -> list[tuple] | None:
    """Segments up to the scan, which is one part with all that follows; None for a broken file.  Fill bytes belong to none."""
    if not data.startswith(b"\xff\xd8"):
        return None
    parts, at = [("D8", 2, 0, 0, 2)], 2
    while found := _MARKER.match(data, at):
        code, at = found[1][0], found.end()
        begin, tag = at - 2, f"{code:02X}"
        if code == 0xD9:
            return parts + [(tag, at, 0, begin, 2)]
        if code == 0x01 or 0xD0 <= code <= 0xD7:
            parts.append((tag, at, 0, begin, 2))
            continue
        size = int.from_bytes(data[at:at + 2], "big")
        end = at + size
        if size < 2 or end > len(data):
            return None
        if code == 0xDA:
            return parts + [(tag, at + 2, size - 2, begin, len(data) - begin)] if data.find(b"\xff\xd9", end) >= 0 else None
        parts.append((tag, at + 2, size - 2, begin, end - begin))
        at = end
    return None


def webp_parts(data: bytes) -> list[tuple] | None:
    """Chunks of a WebP; None if one does not end in the file."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        return None
    parts, at = [], 12
    while at + 8 <= len(data):
        size = int.from_bytes(data[at + 4:at + 8], "little")
        if at + 8 + size > len(data):
            return None
        parts.append((data[at:at + 4].decode("latin-1"), at + 8, size, at, 8 + size))
        at += 8 + size + size % 2
    return parts


def png_parts(data: bytes) -> list[tuple] | None:
    """Chunks of a PNG to its end; None if one does not end in the file.  Check sums are not looked at."""
    if not data.startswith(b"\x89PNG\r\n\x1a\n"):
        return None
    parts, at = [], 8
    while at + 12 <= len(data):
        size, tag = int.from_bytes(data[at:at + 4], "big"), data[at + 4:at + 8].decode("latin-1")
        if at + 12 + size > len(data):
            return None
        parts.append((tag, at + 8, size, at, 12 + size))
        if tag == "IEND":
            break
        at += 12 + size
    return parts


_PARTS = {"jpeg": jpeg_parts, "png": png_parts, "webp": webp_parts}


def _split(data: bytes | None, kind: str | None) -> list[tuple] | None:
    return _PARTS[kind](bytes(data)) if data is not None and kind in _PARTS else None


@F.pandas_udf(_PART)
def parts(content: pd.Series, kind: pd.Series) -> pd.Series:
    """The parts of each file; null for a broken one and for other types."""
    found = (_split(data, name) for data, name in zip(content, kind))
    return pd.Series([None if p is None else [dict(zip(PART, part)) for part in p] for p in found], dtype=object, index=content.index)


def iptc_of(data: bytes) -> bytes | None:
    """The IPTC record among the resources of a Photoshop segment."""
    at = len(PHOTOSHOP)
    while data[at:at + 4] == RESOURCE and at + 12 <= len(data):
        kind = int.from_bytes(data[at + 4:at + 6], "big")
        name = 1 + data[at + 6]
        at += 6 + name + name % 2
        size = int.from_bytes(data[at:at + 4], "big")
        if at + 4 + size > len(data):
            return None
        if kind == IPTC_RESOURCE:
            return data[at + 4:at + 4 + size]
        at += 4 + size + size % 2
    return None


def _inflated(data: bytes) -> bytes | None:
    try:
        return zlib.decompress(data)
    except zlib.error:
        return None


def _icc_of(chunks: list[bytes]) -> bytes | None:
    """A profile from its numbered segments, in whatever order they stand; None if one is missing."""
    numbered = sorted((c[12], c[13], c[14:]) for c in chunks if len(c) >= 14)
    whole = numbered and [n for n, _, _ in numbered] == list(range(1, numbered[0][1] + 1))
    return b"".join(body for _, _, body in numbered) if whole else None


def _international(data: bytes) -> bytes | None:
    """The text of an iTXt chunk with XMP."""
    if not data.startswith(XMP_KEYWORD + b"\0"):
        return None
    packed, rest = data[len(XMP_KEYWORD) + 1:len(XMP_KEYWORD) + 2], data[len(XMP_KEYWORD) + 3:]
    fields = rest.split(b"\0", 2)
    if len(fields) < 3:
        return None
    return _inflated(fields[2]) if packed == b"\1" else fields[2]


def _raw_profile(data: bytes) -> bytes | None:
    """IPTC as hexadecimal digits in a compressed text chunk: a name, a length, the digits."""
    keyword, _, rest = data.partition(b"\0")
    text = _inflated(rest[1:]) if keyword == IPTC_KEYWORD else None
    lines = (text or b"").split()
    try:
        return bytes.fromhex(b"".join(lines[2:]).decode("latin-1")) if len(lines) > 2 else None
    except ValueError:
        return None


def metadata_of(data: bytes | None, kind: str | None) -> tuple[bytes | None, ...]:
    """``exif, icc, xmp, iptc`` of a file; the first of each counts."""
    pieces = [(tag, data[start:start + size]) for tag, start, size, _, _ in _split(data, kind) or []]
    first = lambda found: next((x for x in found if x is not None), None)
    of = lambda name: [body for tag, body in pieces if tag == name]
    after = lambda name, mark: first(b[len(mark):] for b in of(name) if b.startswith(mark))
    if kind == "jpeg":
        iptc = first(iptc_of(b) for b in of("ED") if b.startswith(PHOTOSHOP))
        return after("E1", EXIF), _icc_of([b for b in of("E2") if b.startswith(ICC)]), after("E1", XMP), iptc
    if kind == "png":
        icc = first(_inflated(b.partition(b"\0")[2][1:]) for b in of("iCCP"))
        return first(of("eXIf")), icc, first(map(_international, of("iTXt"))), first(map(_raw_profile, of("zTXt")))
    return first(of("EXIF")), first(of("ICCP")), first(of("XMP ")), None


@F.pandas_udf(_METADATA)
def metadata(content: pd.Series, kind: pd.Series) -> pd.DataFrame:
    """The metadata of each file by its type; types other than JPEG, PNG and WebP, and broken files, have none."""
    rows = [metadata_of(None if data is None else bytes(data), name) for data, name in zip(content, kind)]
    return pd.DataFrame(rows, columns=_METADATA.names, index=content.index, dtype=object)


def _hex_of(content: Column, part: Column, field: str = "") -> Column:
    return F.hex(F.substr(content, part[f"{field}start"] + 1, part[f"{field}size"]))


def rewrite_jpeg(content: Column, found: Column, policy: Column) -> Column:
    """A JPEG without the metadata that a policy drops, its scan untouched; null for a broken one.

    ``found`` are its ``parts``.  ``policy`` is keep_all, preserve_icc,
    preserve_exif or strip_all.  The JFIF and Adobe segments stay always.
    """
    starts = lambda p, mark: F.hex(F.substr(content, p["start"] + 1, F.least(p["size"], F.lit(len(mark))))) == mark.hex().upper()

    def kept(p: Column) -> Column:
        meta = (p["tag"].between("E1", "EF") & (p["tag"] != "EE")) | (p["tag"] == "FE")
        return (
            ~meta | (policy == "keep_all") | ((policy == "preserve_icc") & (p["tag"] == "E2") & starts(p, ICC))
            | ((policy == "preserve_exif") & (p["tag"] == "E1") & starts(p, EXIF))
        )

    return F.unhex(F.array_join(F.transform(F.filter(found, kept), lambda p: _hex_of(content, p, "whole_")), ""))


def _canvas(pieces: list[tuple[str, bytes]]) -> bytes | None:
    """The head of the extended format for a simple file, from its image; None without one."""
    for tag, body in pieces:
        if tag == "VP8 " and len(body) >= 10 and body[3:6] == b"\x9d\x01\x2a":
            size, alpha = struct.unpack_from("<HH", body, 6), any(t == "ALPH" for t, _ in pieces)
            width, height = (n & 0x3FFF for n in size)
            break
        if tag == "VP8L" and len(body) >= 5 and body[0] == 0x2F:
            bits = int.from_bytes(body[1:5], "little")
            width, height, alpha = (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1, bool(bits >> 28 & 1)
            break
    else:
        return None
    if not width or not height:
        return None
    return bytes([16 * alpha, 0, 0, 0]) + (width - 1).to_bytes(3, "little") + (height - 1).to_bytes(3, "little")


def with_webp_metadata(data: bytes, icc: bytes | None, exif: bytes | None, xmp: bytes | None) -> bytes | None:
    """A WebP in the extended format with what it lacks of the three; None for a broken one.

    What the file has already stays.  The order is VP8X, ICCP, image, EXIF, XMP.
    """
    found = webp_parts(data)
    if found is None:
        return None
    pieces = [(tag, data[start:start + size]) for tag, start, size, _, _ in found]
    own = dict(reversed(pieces))
    added = {tag: body for tag, body in (("ICCP", icc), ("EXIF", exif), ("XMP ", xmp)) if body is not None and tag not in own}
    if not added:
        return data
    head = own["VP8X"][:10] if len(own.get("VP8X", b"")) >= 10 else _canvas(pieces)
    if head is None:
        return None
    bits = {"ICCP": 32, "EXIF": 8, "XMP ": 4}
    around = {tag: added.get(tag, own.get(tag)) for tag in bits}
    image = [piece for piece in pieces if piece[0] not in ("VP8X", *bits)]
    written = [
        ("VP8X", bytes([head[0] | sum(bits[tag] for tag in added)]) + head[1:]), ("ICCP", around["ICCP"]), *image,
        ("EXIF", around["EXIF"]), ("XMP ", around["XMP "]),
    ]
    body = b"".join(
        tag.encode("latin-1") + struct.pack("<I", len(b)) + b + bytes(len(b) % 2) for tag, b in written if b is not None
    )
    return b"RIFF" + struct.pack("<I", len(body) + 4) + b"WEBP" + body


@F.pandas_udf(T.BinaryType())
def inject_webp(content: pd.Series, icc: pd.Series, exif: pd.Series, xmp: pd.Series) -> pd.Series:
    rows = ([None if v is None else bytes(v) for v in row] for row in zip(content, icc, exif, xmp))
    return pd.Series([None if data is None else with_webp_metadata(data, *rest) for data, *rest in rows], dtype=object, index=content.index)
