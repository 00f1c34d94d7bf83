"""Parsers of option texts.  Each gives a value, and an error text or null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WHOLE = r"^\+?[0-9]+$"
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def whole32(text: Column) -> Column:
    """An unsigned 32-bit integer, an optional plus before it; null if the text is none."""
    value = F.when(text.rlike(WHOLE), text.try_cast("decimal(38,0)"))
    return F.when(value < 1 << 32, value.cast("long"))


def crop(text: Column) -> Column:
    """``x,y,w,h`` as a struct with an error."""
    parts = F.split(text, ",", -1)
    names = ("x", "y", "width", "height")
    values = [whole32(F.get(parts, k)) for k in range(4)]
    error = F.when(F.size(parts) != 4, F.concat(
        F.lit("crop must be x,y,w,h (four comma-separated integers), got '"), text, F.lit("'")
    ))
    for k, (name, value) in enumerate(zip(names, values)):
        error = error.when(value.isNull(), F.concat(
            F.lit(f"crop {name} must be a non-negative integer, got '"), F.get(parts, k), F.lit("'")
        ))
    error = error.when((values[2] == 0) | (values[3] == 0), F.lit("crop width and height must be greater than zero"))
    return F.struct(*(F.when(error.isNull(), v).alias(n) for n, v in zip(names, values)), error.alias("error"))


def target_quality(text: Column) -> Column:
    """``metric:value``; the metric in any case."""
    split = F.instr(text, ":") > 0
    metric = F.lower(F.substring_index(text, ":", 1))
    raw = F.substr(text, F.instr(text, ":") + 1)
    value = F.when(raw.rlike(NUMBER), raw.try_cast("float"))
    error = (
        F.when(~split, F.lit("targetQuality must be <metric>:<value>, for example ssim:0.98"))
        .when(~metric.isin("ssim", "psnr"), F.concat(F.lit("unsupported quality metric `"), metric, F.lit("`")))
        .when(value.isNull(), F.concat(F.lit("target quality value must be a number, got `"), raw, F.lit("`")))
    )
    return F.struct(
        F.when(error.isNull(), metric).alias("metric"), F.when(error.isNull(), value.cast("double")).alias("value"),
        error.alias("error"),
    )


def colour(text: Column) -> Column:
    """Six or eight hexadecimal digits without a number sign; opaque if six."""
    valid = text.rlike("^([0-9a-fA-F]{6}|[0-9a-fA-F]{8})$")
    byte = lambda at: F.when(valid, F.conv(F.substring(text, at, 2), 16, 10).cast("long"))
    return F.struct(
        byte(1).alias("r"), byte(3).alias("g"), byte(5).alias("b"),
        F.when(valid, F.when(F.length(text) == 8, F.conv(F.substring(text, 7, 2), 16, 10).cast("long")).otherwise(255)).alias("a"),
        F.when(~valid, F.concat(F.lit("unsupported color `"), text, F.lit("`"))).alias("error"),
    )


def one_of(text: Column, names: tuple[str, ...]) -> Column:
    """The text if it is one of the names, else null."""
    return F.when(text.isin(*names), text)


FITS = ("contain", "cover", "fill", "inside")
POSITIONS = ("center", "top", "right", "bottom", "left", "top-left", "top-right", "bottom-left", "bottom-right")
MODES = ("none", "auto", "lossless", "lossy")


def query_pairs(query: Column) -> Column:
    """Form-decoded ``(name, value)`` pairs of a query, in order; empty segments are skipped."""
    decode = lambda c: F.url_decode(c)
    segments = F.filter(F.split(query, "&"), lambda s: s != "")
    return F.transform(segments, lambda s: F.struct(
        decode(F.substring_index(s, "=", 1)).alias("name"),
        F.when(F.instr(s, "=") > 0, decode(F.substr(s, F.instr(s, "=") + 1))).otherwise("").alias("value"),
    ))


def has_duplicates(pairs: Column) -> Column:
    names = F.transform(pairs, lambda p: p["name"])
    return F.size(F.array_distinct(names)) < F.size(names)


def metadata_flags(strip: Column, keep: Column, exif: Column) -> Column:
    """What the three flags mean together, or an error."""
    keep, exif = F.coalesce(keep, F.lit(False)), F.coalesce(exif, F.lit(False))
    error = F.when(keep & exif, F.lit("keepMetadata and preserveExif cannot both be true"))
    return F.struct(
        F.when(error.isNull(), F.when(keep | exif, False).otherwise(F.coalesce(strip, F.lit(True)))).alias("strip_metadata"),
        F.when(error.isNull(), exif).alias("preserve_exif"), error.alias("error"),
    )


def accepts_gzip(header: Column) -> Column:
    """Whether an Accept-Encoding header allows gzip (``*`` included) with a weight above 0."""

    def allows(part: Column) -> Column:
        name = F.lower(F.trim(F.substring_index(part, ";", 1)))
        weight = F.regexp_extract(part, r"(?i);\s*q\s*=\s*([0-9.]+)", 1)
        return name.isin("gzip", "*") & ((weight == "") | (F.coalesce(weight.try_cast("double"), F.lit(0.0)) > 0))

    return F.exists(F.split(header, ","), allows)


def typed(text: Column, kind: str, name: str) -> Column:
    """``(value, error)`` of a query parameter: ``u32``, ``u8``, ``float`` or ``bool``; a missing one has neither."""
    number = whole32(text)
    value, what = {
        "u32": (number, "an integer"), "u8": (F.when(number <= 255, number), "an integer"),
        "float": (F.when(text.rlike(NUMBER) | text.rlike("(?i)^[+-]?(inf|infinity|nan)$"), text.try_cast("float").cast("double")), "a number"),
        "bool": (F.when(text == "true", True).when(text == "false", False), "`true` or `false`"),
    }[kind]
    error = F.when(text.isNotNull() & value.isNull(), F.lit(f"query parameter `{name}` must be {what}"))
    return F.struct(value.alias("value"), error.alias("error"))


def setting_error(text: Column, name: str, low: float, high: float, whole: bool) -> Column:
    """Why a setting is refused; an empty or missing one keeps its default."""
    value = F.when(text.rlike(WHOLE), text.try_cast("decimal(38,0)")).cast("double") if whole else F.when(text.rlike(NUMBER), text.try_cast("double"))
    return (
        F.when(text.isNull() | (text == ""), F.lit(None))
        .when(value.isNull(), f"{name} must be a {'positive integer' if whole else 'number'}")
        .when((value < low) | (value > high), f"{name} must be between {low} and {high}")
    )
