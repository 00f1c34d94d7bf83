"""Public queries and watermark payloads as typed columns, and the rules of a signing client."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import media, parse, signing

# Parameter, the column that it becomes, and its type, in the order in which they are read.
TYPED = (
    ("watermarkOpacity", "watermark_opacity", "u8"), ("watermarkMargin", "watermark_margin", "u32"), ("width", "width", "u32"),
    ("height", "height", "u32"), ("quality", "quality", "u8"), ("autoOrient", "auto_orient", "bool"),
    ("stripMetadata", "strip_metadata", "bool"), ("preserveExif", "preserve_exif", "bool"), ("blur", "blur", "float"), ("sharpen", "sharpen", "float"),
)
# Texts of errors, and the defaults and limit of a watermark.
ORPHANED = "watermarkPosition, watermarkOpacity, and watermarkMargin require watermarkUrl"
BAD_ROTATION = "rotate must be 0, 90, 180, or 270"
WATERMARK_POSITION, WATERMARK_OPACITY, WATERMARK_MARGIN, MARGIN_LIMIT = "bottom-right", 50, 10, 9999


def _named(text: Column, field: str, known: Column, what: str) -> Column:
    """The error of a text that has to be one of some names."""
    return F.when(text.isNotNull() & ~known, F.concat(F.lit(f"{field}: unsupported {what} `"), text, F.lit("`")))


def _field(text: Column, field: str, parsed: Column) -> Column:
    error = F.when(text.isNotNull(), parsed["error"])
    return F.when(error.isNotNull(), F.concat(F.lit(f"{field}: "), error))


def public_requests(df: DataFrame, query: str, kind: str, presets: DataFrame | None = None) -> DataFrame:
    """``df`` with the source, options and watermark of a public query, and ``error``: the first that it breaks.

    ``kind`` is ``path`` or ``url``.  Options that a query leaves out come from
    the preset that it names: ``presets`` has a name and columns called as the
    parameters, all texts.  Columns of ``df`` other than the new ones are kept.
    """
    pairs = df.withColumn("pairs_", parse.query_pairs(F.col(query)))
    names = F.transform("pairs_", lambda p: p["name"])
    places = F.when(F.size(names) > 1, F.sequence(F.lit(1), F.size(names) - 1))
    repeated = F.get(F.transform(F.filter(places, lambda k: F.array_contains(F.slice(names, 1, k), F.get(names, k))), lambda k: F.get(names, k)), 0)
    allowed = [n for n in signing.ALLOWED if n not in ({"path", "url"} - {kind})]
    unknown = F.get(F.array_sort(F.array_except(names, F.array(*map(F.lit, allowed)))), 0)
    rows = pairs.withColumns({"repeated_": repeated, "unknown_": unknown}).withColumn(
        "q_", F.map_from_entries(F.when(F.col("repeated_").isNull(), F.col("pairs_")).otherwise(F.array().cast(pairs.schema["pairs_"].dataType))))
    given = lambda name: F.try_element_at(F.col("q_"), F.lit(name))
    read = ("fit", "position", "format", "optimize", "targetQuality", "background", "crop", "rotate", "preset", "watermarkUrl", "watermarkPosition", "version", kind)
    texts = {f"{n}_": given(n) for n in (*read, *(p for p, _, _ in TYPED))}
    rows = rows.withColumns(texts).drop("pairs_", "q_")
    found = {column: parse.typed(F.col(f"{p}_"), t, p) for p, column, t in TYPED}
    typed_error = lambda *columns: [found[c]["error"] for c in columns]
    mark = ("watermark_opacity", "watermark_margin")
    orphaned = F.col("watermarkUrl_").isNull() & F.coalesce("watermarkPosition_", "watermarkOpacity_", "watermarkMargin_").isNotNull()
    rotation = parse.whole32(F.col("rotate_"))
    early = F.coalesce(
        F.when(F.col("repeated_").isNotNull(), F.concat(F.lit("query parameter `"), F.col("repeated_"), F.lit("` must not be repeated"))),
        F.when(F.col("unknown_").isNotNull(), F.concat(F.lit("query parameter `"), F.col("unknown_"), F.lit("` is not supported for this endpoint"))),
        F.when(F.coalesce(F.col(f"{kind}_"), F.lit("")) == "", f"query parameter `{kind}` is required"),
        F.when(orphaned, ORPHANED), *(F.when(F.col("watermarkUrl_").isNotNull(), e) for e in typed_error(*mark)),
        *typed_error("width", "height", "quality"),
        F.when(F.col("rotate_").isNotNull() & ~F.coalesce(rotation < 65536, F.lit(False)), BAD_ROTATION),
        *typed_error("auto_orient", "strip_metadata", "preserve_exif", "blur", "sharpen"),
    )
    columns = {
        "error": early, **{column: found[column]["value"] for _, column, _ in TYPED}, "rotate": rotation,
        **{n: F.col(f"{n}_") for n in ("fit", "position", "format", "optimize", "background", "crop", "preset", "version")},
        "target_quality": F.col("targetQuality_"), "source": F.col(f"{kind}_"),
        "watermark_url": F.col("watermarkUrl_"), "watermark_position": F.col("watermarkPosition_"),
    }
    keep = [c for c in df.columns if c not in columns]
    out = rows.select(*keep, *(c.alias(n) for n, c in columns.items()))
    return _options(out if presets is None else _with_preset(out, presets))


def _with_preset(rows: DataFrame, presets: DataFrame) -> DataFrame:
    """Options that are not given, from the preset of that name; the table of presets is a configuration."""
    fields = [c for c in presets.columns if c != "name"]
    named = presets.select(F.col("name").alias("preset_name_"), *(F.col(c).alias(f"preset_{c}_") for c in fields))
    joined = rows.join(named, rows["preset"] == named["preset_name_"], "left")
    unknown = F.when(F.col("preset").isNotNull() & F.col("preset_name_").isNull(), F.concat(F.lit("unknown preset `"), F.col("preset"), F.lit("`")))
    merged = {c: F.coalesce(c, f"preset_{c}_") for c in fields}
    return joined.withColumns({"error": F.coalesce("error", unknown), **merged}).drop("preset_name_", *(f"preset_{c}_" for c in fields))


def _options(rows: DataFrame) -> DataFrame:
    """Names checked, and where there is no error the defaults filled in; nulls everywhere where there is one."""
    c = F.col
    late = F.coalesce(
        _named(c("fit"), "fit", c("fit").isin(*parse.FITS), "fit mode"),
        _named(c("position"), "position", c("position").isin(*parse.POSITIONS), "position"),
        _named(c("format"), "format", media.parse_media_type(c("format")).isNotNull(), "media type"),
        _named(c("optimize"), "optimize", c("optimize").isin(*parse.MODES), "optimize mode"),
        _field(c("target_quality"), "targetQuality", parse.target_quality(c("target_quality"))),
        _field(c("background"), "background", parse.colour(c("background"))),
        _named(c("rotate").cast("string"), "rotate", c("rotate").isin(0, 90, 180, 270), "rotation"),
        _field(c("crop"), "crop", parse.crop(c("crop"))),
    )
    rows = rows.withColumn("error", F.coalesce("error", late))
    good = c("error").isNull()
    filled = {
        "format": media.parse_media_type(c("format")), "optimize": F.coalesce("optimize", F.lit("none")), "rotate": F.coalesce("rotate", F.lit(0)),
        "auto_orient": F.coalesce("auto_orient", F.lit(True)), "strip_metadata": F.coalesce("strip_metadata", F.lit(True)),
        "preserve_exif": F.coalesce("preserve_exif", F.lit(False)),
    }
    plain = (*(n for _, n, _ in TYPED if n not in filled), "fit", "position", "background", "crop", "target_quality", "preset", "version", "source", "watermark_url", "watermark_position")
    return rows.withColumns({n: F.when(good, v) for n, v in {**filled, **{n: c(n) for n in plain}}.items()})


def watermark_payload(present: Column, url: Column, position: Column, opacity: Column, margin: Column) -> Column:
    """``(url, position, opacity, margin, error)`` of a watermark with its defaults; all null where there is none."""
    strength, border = F.coalesce(opacity, F.lit(WATERMARK_OPACITY)), F.coalesce(margin, F.lit(WATERMARK_MARGIN))
    error = F.when(present, F.coalesce(
        F.when(F.coalesce(url, F.lit("")) == "", "watermark.url is required when watermark is present"),
        _named(position, "watermark.position", position.isin(*parse.POSITIONS), "position"),
        F.when(~strength.between(1, 100), "watermark.opacity must be between 1 and 100"),
        F.when(border > MARGIN_LIMIT, f"watermark.margin must be at most {MARGIN_LIMIT}"),
    ))
    good = present & error.isNull()
    values = {"url": url, "position": F.coalesce(position, F.lit(WATERMARK_POSITION)), "opacity": strength, "margin": border}
    return F.struct(*(F.when(good, v).alias(n) for n, v in values.items()), error.alias("error"))


def client_error(df: DataFrame) -> Column:
    """The first rule that a request breaks before it is signed; rules on the output count only where a format is given."""
    c = lambda name: df[name]
    boxed, named = c("width").isNotNull() & c("height").isNotNull(), c("format").isNotNull()
    mode, exif = F.coalesce(c("optimize"), F.lit("none")), F.coalesce(c("preserve_exif"), F.lit(False))
    lossy, packs = media.media_flag(c("format"), "lossy"), media.media_flag(c("format"), "optimizable")
    return F.coalesce(
        F.when(c("fit").isNotNull() & ~boxed, "fit requires both width and height"),
        F.when(c("position").isNotNull() & ~boxed, "position requires both width and height"),
        F.when(exif & F.coalesce(c("strip_metadata"), F.lit(True)), "preserveExif requires stripMetadata to be false"),
        F.when((mode != "none") & named & ~packs, F.concat(F.lit("optimization is not supported for "), c("format"), F.lit(" output"))),
        F.when((mode == "lossy") & named & ~lossy, F.concat(F.lit("lossy optimization requires jpeg, webp, or avif output, got "), c("format"))),
        F.when(exif & (c("format") == "svg"), "preserveExif is not supported with SVG output"),
        F.when(c("quality").isNotNull() & named & ~lossy, "quality requires a lossy output format"),
        F.when(c("quality").isNotNull() & (mode == "lossless"), "quality cannot be combined with optimize=lossless"),
        F.when(c("target_metric").isNotNull() & mode.isin("none", "lossless"), "targetQuality requires optimize=auto or optimize=lossy"),
        F.when(c("target_metric").isNotNull() & named & ~lossy, "targetQuality requires jpeg, webp, or avif output"),
    )
