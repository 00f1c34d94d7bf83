"""JSON payloads of transform options, closed: every field has a type, and a name that is not known is refused."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import parse
from ..functions.media import parse_media_type

WHOLE, TEXT, FLAG, NUMBER = "whole", "text", "flag", "number"
#: Fields of both kinds of payload with their types; whole numbers with their largest value.
FIELDS = {
    "width": (WHOLE, (1 << 32) - 1), "height": (WHOLE, (1 << 32) - 1), "fit": (TEXT, None), "position": (TEXT, None), "format": (TEXT, None),
    "quality": (WHOLE, 255), "optimize": (TEXT, None), "targetQuality": (TEXT, None), "background": (TEXT, None), "rotate": (WHOLE, 65535),
    "autoOrient": (FLAG, None), "preserveExif": (FLAG, None), "crop": (TEXT, None), "blur": (NUMBER, None), "sharpen": (NUMBER, None),
}
_KINDS = {WHOLE: "^BIGINT$", TEXT: "^STRING$", FLAG: "^BOOLEAN$", NUMBER: r"^(BIGINT|DOUBLE|DECIMAL\(.*\))$"}
_TYPES = {WHOLE: "bigint", TEXT: "string", FLAG: "boolean", NUMBER: "double"}


def options(df: DataFrame, text: str, browser: bool = False) -> DataFrame:
    """``df`` with ``options`` (null where there is an error) and ``error`` of the JSON in ``text``.

    The server's payload has stripMetadata; the browser's has keepMetadata in
    its place, and words its errors in another way.  A field may be missing or
    null.  In order: what is no JSON object, unknown names, values of another
    type, then the values themselves.  Flags default to true but preserveExif.
    """
    fields = FIELDS | {"keepMetadata" if browser else "stripMetadata": (FLAG, None)}
    # inside another object, so that nothing may follow it
    within = F.concat(F.lit('{"a":'), F.col(text), F.lit(',"b":0}'))
    alone = F.size(F.json_object_keys(within)) == 2
    parsed = df.withColumn("json_", F.when(alone, F.try_variant_get(F.try_parse_json(within), "$.a", "variant")))
    held = parsed.withColumn("names_", F.when(F.schema_of_variant("json_").startswith("OBJECT"), F.json_object_keys(text)))
    field = lambda name: F.try_variant_get("json_", f"$.{name}", "variant")
    read = held.withColumn("kinds_", F.struct(*(F.schema_of_variant(field(n)).alias(n) for n in fields))).withColumn(
        "is_", F.struct(*(F.try_variant_get("json_", f"$.{n}", _TYPES[kind]).alias(n) for n, (kind, _) in fields.items()))
    )
    unknown = F.get(F.array_except("names_", F.array(*map(F.lit, fields))), 0)
    wrong = F.coalesce(*(F.when(_mistyped(n, *fields[n]), F.lit(n)) for n in fields))
    error = F.when(F.col("names_").isNull(), "invalid JSON").when(unknown.isNotNull(), F.concat(F.lit("unknown field `"), unknown, F.lit("`"))).when(
        wrong.isNotNull(), F.concat(F.lit("invalid value for `"), wrong, F.lit("`"))
    )
    value = lambda name: F.col(f"is_.{name}")
    made = read.withColumn("error_", error).withColumn("made_", F.struct(
        parse.target_quality(value("targetQuality")).alias("target"), parse.colour(value("background")).alias("background"), parse.crop(value("crop")).alias("crop"),
        parse.metadata_flags(F.lit(None).cast("boolean"), value("keepMetadata"), value("preserveExif")).alias("flags") if browser else F.lit(None).alias("flags"),
    ))
    not_in = lambda name, known, what: F.when(
        value(name).isNotNull() & known, F.concat(F.lit(f"unsupported {what} `"), value(name).cast("string"), F.lit("`"))
    )
    named = lambda name, reason: F.when(
        value(name).isNotNull() & reason.isNotNull(), F.concat(F.lit(f"{name} is invalid: " if browser else f"{name}: "), reason)
    )
    reasons = {
        "fit": not_in("fit", ~value("fit").isin(*parse.FITS), "fit mode"), "position": not_in("position", ~value("position").isin(*parse.POSITIONS), "position"),
        "format": not_in("format", parse_media_type(value("format")).isNull(), "media type"),
        "optimize": not_in("optimize", ~value("optimize").isin(*parse.MODES), "optimize mode"),
        "targetQuality": F.col("made_.target.error"), "background": F.col("made_.background.error"),
        "rotate": not_in("rotate", ~value("rotate").isin(0, 90, 180, 270), "rotation"), "crop": F.col("made_.crop.error"),
    }
    order = [n for n in reasons if n not in ("rotate", "crop")] + (["crop", "rotate"] if browser else ["rotate", "crop"])
    first = [F.col("error_")] + ([F.col("made_.flags.error")] if browser else [])
    judged = made.withColumn("error", F.coalesce(*first, *(named(n, reasons[n]) for n in order)))
    strip = F.col("made_.flags.strip_metadata") if browser else F.coalesce(value("stripMetadata"), F.lit(True))
    found = F.struct(
        value("width").alias("width"), value("height").alias("height"), value("fit").alias("fit"), value("position").alias("position"),
        parse_media_type(value("format")).alias("format"), value("quality").alias("quality"), F.coalesce(value("optimize"), F.lit("none")).alias("optimize"),
        F.col("made_.target.metric").alias("target_metric"), F.col("made_.target.value").alias("target_value"),
        F.when(value("background").isNotNull(), F.struct(*(F.col(f"made_.background.{c}").alias(c) for c in "rgba"))).alias("background"),
        F.coalesce(value("rotate"), F.lit(0)).alias("rotate"), F.coalesce(value("autoOrient"), F.lit(True)).alias("auto_orient"), strip.alias("strip_metadata"),
        F.coalesce(value("preserveExif"), F.lit(False)).alias("preserve_exif"),
        F.when(value("crop").isNotNull(), F.struct(*(F.col(f"made_.crop.{c}").alias(c) for c in ("x", "y", "width", "height")))).alias("crop"),
        value("blur").alias("blur"), value("sharpen").alias("sharpen"),
    )
    return judged.withColumn("options", F.when(F.col("error").isNull(), found)).select(*df.columns, "options", "error")


def _mistyped(name: str, kind: str, most: int | None) -> Column:
    """Whether a field is there and neither null nor of its type and range."""
    found, value = F.col(f"kinds_.{name}"), F.col(f"is_.{name}")
    bad = ~found.rlike(_KINDS[kind])
    if most is not None:
        bad = bad | ~value.between(0, most)
    return F.coalesce(found.isNotNull() & (found != "VOID") & F.coalesce(bad, F.lit(True)), F.lit(False))
