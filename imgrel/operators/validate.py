"""Validation of transform requests: the first error in a fixed order, as data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.media import MAX_INPUT_PIXELS, MAX_OUTPUT_PIXELS, media_flag


def output_format(df: DataFrame) -> Column:
    return F.coalesce(df["format"], df["input_type"])


def first_error(df: DataFrame) -> Column:
    """The message of the first rule that a request breaks; null if it keeps all."""
    c = lambda name: df[name]
    fmt = output_format(df)
    boxed = c("width").isNotNull() & c("height").isNotNull()
    rules: list[tuple[Column, Column | str]] = [
        (c("width") == 0, "width must be greater than zero"),
        (c("height") == 0, "height must be greater than zero"),
        (~c("quality").between(1, 100), "quality must be between 1 and 100"),
        (F.isnan("target_value") | (F.abs("target_value") == float("inf")), "targetQuality must be finite"),
        ((c("target_metric") == "ssim") & ((c("target_value") <= 0) | (c("target_value") > 1)),
         "ssim targetQuality must be greater than 0.0 and at most 1.0"),
        ((c("target_metric") == "psnr") & (c("target_value") <= 0), "psnr targetQuality must be greater than 0"),
        (~c("blur").between(0.1, 100.0), "blur sigma must be between 0.1 and 100.0"),
        (~c("sharpen").between(0.1, 100.0), "sharpen sigma must be between 0.1 and 100.0"),
        ((c("crop_width") == 0) | (c("crop_height") == 0), "crop width and height must be greater than zero"),
        (c("fit").isNotNull() & ~boxed, "fit requires both width and height"),
        (c("position").isNotNull() & ~boxed, "position requires both width and height"),
        (c("preserve_exif") & c("strip_metadata"), "preserve_exif requires strip_metadata to be false"),
        ((c("optimize") != "none") & ~media_flag(fmt, "optimizable"),
         F.concat(F.lit("optimization is not supported for "), fmt, F.lit(" output"))),
        ((c("optimize") == "lossy") & ~media_flag(fmt, "lossy_optimizable"),
         F.concat(F.lit("lossy optimization requires jpeg, webp, or avif output, got "), fmt)),
        (c("preserve_exif") & (fmt == "svg"), "preserveExif is not supported with SVG output"),
        (c("quality").isNotNull() & ~media_flag(fmt, "lossy"), "quality requires a lossy output format"),
        (c("quality").isNotNull() & (c("optimize") == "lossless"), "quality cannot be combined with optimize=lossless"),
        (c("target_metric").isNotNull() & c("optimize").isin("none", "lossless"),
         "targetQuality requires optimize=auto or optimize=lossy"),
        (c("target_metric").isNotNull() & ~media_flag(fmt, "lossy_optimizable"),
         "targetQuality requires jpeg, webp, or avif output"),
    ]
    return F.coalesce(*(F.when(bad, F.lit(text) if isinstance(text, str) else text) for bad, text in rules))


def normalize(df: DataFrame) -> DataFrame:
    """Requests with ``error``, and where there is none the defaults filled in."""
    fmt = output_format(df)
    boxed = df["width"].isNotNull() & df["height"].isNotNull()
    policy = (
        F.when(df["preserve_exif"], "preserve_exif")
        .when(df["strip_metadata"] & (df["optimize"] == "lossy") & media_flag(fmt, "icc"), "preserve_icc")
        .when(df["strip_metadata"], "strip_all").otherwise("keep_all")
    )
    return df.withColumns({
        "error": first_error(df), "fmt": fmt,
        "fit": F.when(boxed, F.coalesce(df["fit"], F.lit("contain"))),
        "position": F.coalesce(df["position"], F.lit("center")), "policy": policy,
    })


def svg_error(df: DataFrame, watermark: Column | None = None) -> Column:
    """What a vector input refuses before anything else is looked at."""
    refuse = lambda asked, what: F.when(asked, F.lit(f"{what} is not supported for SVG inputs"))
    return F.coalesce(
        refuse(df["blur"].isNotNull(), "blur"), refuse(df["sharpen"].isNotNull(), "sharpen"),
        refuse(F.lit(False) if watermark is None else watermark, "watermark"), refuse(df["crop_width"].isNotNull(), "crop"),
    )


def route(df: DataFrame) -> Column:
    """Which way a request goes by its input: vector, raster, or refused because a raster cannot become a vector image."""
    return F.when(df["input_type"] == "svg", "svg").when(df["format"] == "svg", "UnsupportedOutput").otherwise("raster")


def watermark_error(opacity: Column, media: Column) -> Column:
    return (
        F.when(~opacity.between(1, 100), "watermark opacity must be between 1 and 100")
        .when(~media_flag(media, "raster"), "watermark image must be a raster format")
    )


def pixels_error(w: Column, h: Column, limit: int, what: str) -> Column:
    """A limit on w * h; sizes that are not known are not limited."""
    pixels = w * h
    return F.when(pixels > limit, F.concat(F.lit(f"{what} has "), pixels.cast("string"), F.lit(f" pixels, limit is {limit}")))


def input_error(w: Column, h: Column) -> Column:
    return pixels_error(w, h, MAX_INPUT_PIXELS, "input image")


def output_error(w: Column, h: Column) -> Column:
    return pixels_error(w, h, MAX_OUTPUT_PIXELS, "output image")


def merge_presets(df: DataFrame, presets: DataFrame, fields: list[str]) -> DataFrame:
    """Fill null fields from the preset that a request names; ``error`` for an unknown one.

    Presets are a table of the operator's own settings; Spark broadcasts it if
    it is small enough.
    """
    named = presets.select(F.col("name").alias("preset_name"), *(F.col(f).alias(f"preset_{f}") for f in fields))
    joined = df.join(named, df["preset"] == named["preset_name"], "left")
    return joined.select(
        *(df[c] for c in df.columns if c not in fields), *(F.coalesce(df[f], F.col(f"preset_{f}")).alias(f) for f in fields),
        F.when(df["preset"].isNotNull() & F.col("preset_name").isNull(), F.concat(F.lit("unknown preset `"), df["preset"], F.lit("`"))).alias("error"),
    )
