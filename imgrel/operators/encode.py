"""Files from pixels, and metadata put into files, by built-in functions."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from ..functions import containers


def be(value: Column, width: int) -> Column:
    """A whole number as big-endian bytes."""
    return F.unhex(F.lpad(F.hex(value.cast("long")), 2 * width, "0"))


def le(value: Column, width: int) -> Column:
    digits = F.lpad(F.hex(value.cast("long")), 2 * width, "0")
    return F.unhex(F.concat(*(F.substring(digits, 2 * k + 1, 2) for k in range(width - 1, -1, -1))))


def rows_of(px: DataFrame, bottom_up: bool, channels: int, pad_to: int = 1) -> DataFrame:
    """``(image_id, w, h, data)``: grey pixels as ``channels`` equal bytes, rows padded to ``pad_to`` bytes.

    A row is gathered in one task and then an image; a raster is one value in the end.
    """
    one = F.lpad(F.hex(F.col("v")), 2, "0")
    line = px.groupBy("image_id", "y").agg(
        F.array_sort(F.collect_list(F.struct("x", F.repeat(one, F.lit(channels)).alias("p")))).alias("line")
    )
    text = F.array_join(F.transform("line", lambda p: p["p"]), "")
    width = F.size("line")
    padding = F.pmod(-(width * channels), F.lit(pad_to))
    line = line.select("image_id", "y", width.alias("w"), F.concat(text, F.repeat(F.lit("00"), padding)).alias("text"))
    order = -F.col("y") if bottom_up else F.col("y")
    return line.groupBy("image_id").agg(
        F.max("w").alias("w"), F.count(F.lit(1)).alias("h"), F.array_sort(F.collect_list(F.struct(order.alias("o"), "text"))).alias("lines")
    ).select("image_id", "w", "h", F.unhex(F.array_join(F.transform("lines", lambda p: p["text"]), "")).alias("data"))


def bmp(px: DataFrame) -> DataFrame:
    """``(image_id, content)``: grey pixels as a 24-bit bitmap."""
    rows, lit = rows_of(px, bottom_up=True, channels=3, pad_to=4), lambda h: F.unhex(F.lit(h))
    size = F.octet_length("data")
    content = F.concat(
        lit("424D"), le(size + 54, 4), lit("00000000"), lit("36000000"), lit("28000000"), le(F.col("w"), 4), le(F.col("h"), 4),
        lit("01001800"), lit("00000000"), le(size, 4), lit("130B0000130B00000000000000000000"), F.col("data"),
    )
    return rows.select("image_id", content.alias("content"))


@F.pandas_udf(BinaryType())
def deflate(data: pd.Series) -> pd.Series:
    return data.map(lambda b: None if b is None else zlib.compress(bytes(b), 6))


def png_chunk(kind: str, data: Column) -> Column:
    body = F.concat(F.lit(kind).cast("binary"), data)
    return F.concat(be(F.octet_length(data), 4), body, be(F.crc32(body), 4))


def png(px: DataFrame) -> DataFrame:
    """``(image_id, content)``: grey pixels as an 8-bit PNG.  Only the compression itself is Python."""
    filtered = px.select("image_id", "y", (F.col("x") + 1).alias("x"), "v").unionByName(
        px.select("image_id", "y").distinct().select("image_id", "y", F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("v"))
    )
    rows = rows_of(filtered, bottom_up=False, channels=1).withColumn("packed", deflate("data"))
    head = F.concat(be(F.col("w") - 1, 4), be(F.col("h"), 4), F.unhex(F.lit("0800000000")))
    content = F.concat(
        F.unhex(F.lit("89504E470D0A1A0A")), png_chunk("IHDR", head), png_chunk("IDAT", F.col("packed")), png_chunk("IEND", F.unhex(F.lit("")))
    )
    return rows.select("image_id", content.alias("content"))


def png_xmp(content: Column, xmp: Column) -> Column:
    """A PNG with an XMP text chunk after its header."""
    data = F.concat(F.lit("XML:com.adobe.xmp").cast("binary"), F.unhex(F.lit("0000000000")), xmp.cast("binary"))
    rest = F.substr(content, F.lit(34), F.octet_length(content))
    return F.concat(F.substr(content, F.lit(1), F.lit(33)), png_chunk("iTXt", data), rest)


def jpeg_xmp(content: Column, xmp: Column) -> Column:
    """A JPEG with an XMP segment after its first marker; null if the payload is too long for one."""
    data = F.concat(F.lit("http://ns.adobe.com/xap/1.0/").cast("binary"), F.unhex(F.lit("00")), xmp.cast("binary"))
    out = F.concat(F.unhex(F.lit("FFD8FFE1")), be(F.octet_length(data) + 2, 2), data, F.substr(content, F.lit(3), F.octet_length(content)))
    return F.when(F.octet_length(data) + 2 <= 65535, out)


def metadata_warnings(policy: Column, output: Column, has_xmp: Column, has_iptc: Column) -> Column:
    """The kinds of metadata that an output cannot hold, when all is to be kept."""
    kept = policy == "keep_all"
    return F.array_compact(F.array(
        F.when(kept & has_xmp & ~output.isin("jpeg", "png", "webp"), "XMP"), F.when(kept & has_iptc & (output != "jpeg"), "IPTC"),
    ))


def jpeg_iptc(content: Column, iptc: Column) -> Column:
    """A JPEG with an IPTC record after its first marker; null if the record is too long for a segment."""
    size = F.octet_length(iptc)
    data = F.concat(
        F.lit(containers.PHOTOSHOP), F.lit(containers.RESOURCE), be(F.lit(containers.IPTC_RESOURCE), 2), F.unhex(F.lit("0000")),
        be(size, 4), iptc.cast("binary"), F.unhex(F.when(size % 2 == 1, "00").otherwise("")),
    )
    out = F.concat(F.unhex(F.lit("FFD8FFED")), be(F.octet_length(data) + 2, 2), data, F.substr(content, F.lit(3), F.octet_length(content)))
    return F.when(F.octet_length(data) + 2 <= 65535, out)


def inject(content: Column, media: Column, meta: Column) -> Column:
    """``(content, dropped)``: a file with the XMP and IPTC (WebP: ICC, EXIF and XMP) of ``meta``, and what it could not take.

    In a JPEG the XMP segment stands first.  A broken WebP stays as it is.
    """
    iptc = F.when(meta["iptc"].isNotNull(), jpeg_iptc(content, meta["iptc"]))
    with_iptc = F.coalesce(iptc, content)
    xmp = F.when(meta["xmp"].isNotNull(), F.when(media == "jpeg", jpeg_xmp(with_iptc, meta["xmp"])).when(media == "png", png_xmp(content, meta["xmp"])))
    webp = F.when(media == "webp", containers.inject_webp(F.when(media == "webp", content), meta["icc"], meta["exif"], meta["xmp"]))
    out = F.when(media == "jpeg", F.coalesce(xmp, with_iptc)).when(media == "webp", F.coalesce(webp, content)).otherwise(F.coalesce(xmp, content))
    dropped = F.array_compact(F.array(
        F.when(meta["xmp"].isNotNull() & xmp.isNull() & webp.isNull(), "XMP"),
        F.when(meta["iptc"].isNotNull() & ((media != "jpeg") | iptc.isNull()), "IPTC"),
    ))
    return F.struct(out.alias("content"), dropped.alias("dropped"))


def passthrough(df: DataFrame) -> Column:
    """Whether an output is the input's own scan: ``passthrough``, ``CapabilityMissing``, or null where pixels are encoded.

    Lossless JPEG output needs an input of the same type, no change of pixels
    and an orientation that turns nothing; AVIF has no lossless optimisation.
    """
    unset = F.lit(True)
    for name in ("width", "height", "quality", "background", "crop_width", "blur", "sharpen"):
        unset = unset & df[name].isNull()
    same = (df["input_type"] == df["format"]) & unset & (F.coalesce(df["rotate"], F.lit(0)) == 0)
    upright = ~df["auto_orient"] | (F.coalesce(df["orientation"], F.lit(1)) <= 1)
    return F.when(df["optimize"] == "lossless", F.when(df["format"] == "jpeg", F.when(same & upright, "passthrough").otherwise("CapabilityMissing"))
                  .when(df["format"] == "avif", "CapabilityMissing"))
