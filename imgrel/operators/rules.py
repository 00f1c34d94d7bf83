"""Rules on requests and settings: crops, format preferences, payloads, encoding plans, keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.media import media_flag, parse_media_type

PAYLOAD = "width long, height long, format string, quality int, autoOrient boolean, stripMetadata boolean"


def crop_error(x: Column, y: Column, width: Column, height: Column, image_w: Column, image_h: Column) -> Column:
    """Why a region cannot be cut from an image that is turned already; null if it can."""
    text = F.format_string("crop region %dx%d+%d+%d exceeds image bounds %dx%d", width, height, x, y, image_w, image_h)
    return F.when((x + width > image_w) | (y + height > image_h), text)


def preference_error(text: Column) -> Column:
    """The first segment of a format preference that is unknown or comes again; null if there is none."""
    names = F.filter(F.transform(F.split(text, ","), lambda s: F.trim(s)), lambda s: s != "")
    kinds = F.transform(names, parse_media_type)
    places = F.when(F.size(names) > 0, F.sequence(F.lit(0), F.size(names) - 1))
    wrong = F.filter(places, lambda k: F.get(kinds, k).isNull() | F.array_contains(F.slice(kinds, 1, k), F.get(kinds, k)))
    at = F.get(wrong, 0)
    what = F.when(F.get(kinds, at).isNull(), "unknown").otherwise("duplicate")
    return F.when(at.isNotNull(), F.concat(what, F.lit(" format `"), F.get(names, at), F.lit("`")))


def payload(text: Column) -> Column:
    """``(options, error)`` of a JSON payload; unknown names are refused, flags default to true."""
    known = [x.split()[0] for x in PAYLOAD.split(", ")]
    names = F.json_object_keys(text)
    unknown = F.get(F.array_except(names, F.array(*map(F.lit, known))), 0)
    error = F.when(names.isNull(), "invalid JSON").when(unknown.isNotNull(), F.concat(F.lit("unknown field `"), unknown, F.lit("`")))
    value = F.from_json(text, PAYLOAD)
    options = F.struct(
        value["width"].alias("width"), value["height"].alias("height"), value["format"].alias("format"), value["quality"].alias("quality"),
        F.coalesce(value["autoOrient"], F.lit(True)).alias("auto_orient"), F.coalesce(value["stripMetadata"], F.lit(True)).alias("strip_metadata"),
    )
    return F.struct(F.when(error.isNull(), options).alias("options"), error.alias("error"))


def encode_plan(mode: Column, media: Column, quality: Column, target: Column) -> Column:
    """``(action, target, max_quality)``: how an output is to be encoded.

    Lossy modes search for the lowest quality that reaches the target; without
    one and without a quality the media type's own target counts.
    """
    goal = F.coalesce(target, F.when(quality.isNull(), media_flag(media, "default_ssim")))
    lossless = F.when(media.isin("png", "webp"), "lossless").when(media.isin("jpeg", "avif"), "CapabilityMissing").otherwise("InvalidOptions")
    lossy = F.when(~media_flag(media, "lossy_optimizable"), "InvalidOptions").when(goal.isNotNull(), "search").otherwise("quality")
    action = F.when(mode == "none", "baseline").when(mode == "auto", "smaller").when(mode == "lossless", lossless).otherwise(lossy)
    searched = action == "search"
    return F.struct(
        action.alias("action"), F.when(searched, goal).cast("double").alias("target"),
        F.when(searched | (action == "quality"), F.coalesce(quality, F.lit(100))).cast("long").alias("max_quality"),
    )


def signing_keys(single: DataFrame, listed: DataFrame) -> DataFrame:
    """Both tables of ``(key_id, secret)`` as one; a listed key takes the place of a single one of the same id."""
    usable = "key_id <> '' AND secret <> ''"
    both = single.where(usable).withColumnRenamed("secret", "single").join(
        listed.where(usable).withColumnRenamed("secret", "listed"), "key_id", "full_outer")
    return both.select("key_id", F.coalesce("listed", "single").alias("secret"))


def request_id(header: Column) -> Column:
    """A request id that may be passed on; null for an empty one or one with control characters."""
    return F.when((header != "") & ~header.rlike("[\\r\\n\\x00]"), header)
