"""Content negotiation and response headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .media import MEDIA_TYPES
from .parse import NUMBER

# Media ranges that an Accept header may name, with their specificity.
RANGES = {
    "*/*": 0, "image/*": 1, "image/jpeg": 2, "image/png": 2, "image/webp": 2, "image/avif": 2, "image/bmp": 2, "image/svg+xml": 2,
}


def preferences(accept: Column) -> Column:
    """``(range, q, specificity)`` of each segment that parses; q in thousandths."""

    def parse(segment: Column) -> Column:
        media = F.lower(F.trim(F.substring_index(segment, ";", 1)))
        parameters = F.slice(F.split(segment, ";"), 2, 1_000)
        weights = F.transform(
            F.filter(parameters, lambda p: (F.instr(p, "=") > 0) & (F.lower(F.trim(F.substring_index(p, "=", 1))) == "q")),
            lambda p: F.trim(F.substr(p, F.instr(p, "=") + 1)),
        )
        number = lambda t: F.when(t.rlike(NUMBER), t.try_cast("double"))
        bad = F.exists(weights, lambda t: F.coalesce(~number(t).between(0, 1), F.lit(True)))
        q = F.coalesce(F.round(number(F.try_element_at(weights, F.lit(-1))) * 1000), F.lit(1000.0)).cast("long")
        rank = F.lit(None).cast("long")
        for name, specificity in RANGES.items():
            rank = F.when(media == name, F.lit(specificity)).otherwise(rank)
        return F.struct(media.alias("range"), q.alias("q"), F.when(~bad, rank).alias("specificity"))

    segments = F.filter(F.transform(F.split(accept, ","), lambda x: F.trim(x)), lambda s: s != "")
    return F.filter(F.transform(segments, parse), lambda p: p["specificity"].isNotNull())


def candidates(input_type: Column, has_alpha: Column) -> Column:
    """Output types in the server's order; an input type that is not among them comes first."""
    base = F.when(has_alpha, F.array(*map(F.lit, ("avif", "webp", "png", "jpeg")))).otherwise(
        F.array(*map(F.lit, ("avif", "webp", "jpeg", "png")))
    )
    return F.when(F.array_contains(base, input_type), base).otherwise(F.concat(F.array(input_type), base))


def negotiate(df: DataFrame) -> DataFrame:
    """``df`` (accept, input_type, has_alpha) with ``chosen`` and ``status``.

    Of a candidate's matching ranges the one with the largest weight counts,
    then the most specific.  The candidate with the largest weight, then the
    most specific range, then the earliest place is chosen.  All inside one
    row, so nothing is shuffled.
    """
    mimes = F.create_map(*(F.lit(x) for row in MEDIA_TYPES for x in row[:2]))

    def choose(x: Column) -> Column:
        def best(kind: Column, place: Column) -> Column:
            mime = F.element_at(mimes, kind)
            matching = F.filter(x["prefs"], lambda p: p["range"].isin("*/*", "image/*") | (p["range"] == mime))
            top = F.array_max(F.transform(matching, lambda p: F.struct(p["q"].alias("q"), p["specificity"].alias("s"))))
            return F.struct(F.coalesce(top["q"], F.lit(0)).alias("q"), F.coalesce(top["s"], F.lit(0)).alias("s"), (-place).alias("p"), kind.alias("kind"))

        top = F.array_max(F.transform(x["types"], best))
        return F.struct(F.when(F.size(x["prefs"]) > 0, top).alias("top"))

    # the parsed header is one value in here, which is not computed for each candidate again
    parsed = F.struct(preferences(F.col("accept")).alias("prefs"), candidates(F.col("input_type"), F.col("has_alpha")).alias("types"))
    chosen = F.element_at(F.transform(F.array(parsed), choose), 1)["top"]
    asked = F.exists(F.split("accept", ","), lambda s: F.trim(s) != "")
    out = df.withColumn("top", chosen)
    none = F.col("accept").isNull() | ~F.coalesce(asked, F.lit(False))
    ok = ~none & F.coalesce(F.col("top.q") > 0, F.lit(False))
    return out.select(
        *df.columns, F.when(ok, F.col("top.kind")).alias("chosen"),
        F.when(none | ok, 200).otherwise(406).cast("long").alias("status"),
    )


def etag(body: Column) -> Column:
    return F.concat(F.lit('"sha256-'), F.sha2(body, 256), F.lit('"'))


def not_modified(if_none_match: Column, tag: Column) -> Column:
    """Whether an If-None-Match list names the tag; weak tags count as strong."""
    bare = lambda c: F.regexp_replace(c, '^"+|"+$', "")
    matches = F.exists(
        F.transform(F.split(if_none_match, ","), lambda x: F.trim(x)),
        lambda t: (t == "*") | (bare(F.trim(F.regexp_replace(t, "^W/", ""))) == bare(tag)),
    )
    return F.coalesce(matches, F.lit(False))


def response_headers(media: Column, tag: Column, public: Column, negotiated: Column, hit: Column, name: str = "imgrel") -> Column:
    """The headers of an image response as a map."""
    pair = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))
    entries = F.array(
        pair("Cache-Control", F.when(public, "public, max-age=3600, stale-while-revalidate=60").otherwise("no-store")),
        pair("ETag", tag), pair("X-Content-Type-Options", F.lit("nosniff")),
        pair("Content-Disposition", F.concat(F.lit(f'inline; filename="{name}.'), media, F.lit('"'))),
        pair("Vary", F.when(negotiated, F.lit("Accept"))),
        pair("Content-Security-Policy", F.when(media == "svg", F.lit("sandbox"))),
        pair("Cache-Status", F.when(hit, F.lit(f'"{name}"; hit')).otherwise(F.lit(f'"{name}"; fwd=miss'))),
    )
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))
