"""The transform cache as tables: keys, lookups, eviction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.media import media_flag
from .scan import running_sum


def number_text(x: Column) -> Column:
    """A number as its shortest text, whole ones without a point."""
    return F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string"))


def parameters(df: DataFrame) -> Column:
    """The canonical parameters of a request in their fixed order, defaults filled in."""
    c = lambda n: df[n]
    boxed = c("width").isNotNull() & c("height").isNotNull()
    pair = lambda name, value, when=None: F.when(
        value.isNotNull() if when is None else when & value.isNotNull(), F.concat(F.lit(f"{name}="), value)
    )
    fmt = c("format")
    default = media_flag(fmt, "default_ssim")
    target = F.when(
        c("target_metric").isNotNull(), F.concat(c("target_metric"), F.lit(":"), number_text(c("target_value")))
    ).when(
        c("optimize").isin("auto", "lossy") & c("quality").isNull() & default.isNotNull(),
        F.concat(F.lit("ssim:"), default.cast("string")),
    )
    background = F.when(F.length(c("background")) == 6, F.concat(c("background"), F.lit("ff"))).otherwise(c("background"))
    crop = F.when(c("crop_width").isNotNull(), F.concat(F.lit("0,0,"), c("crop_width").cast("string"), F.lit(","), c("crop_height").cast("string")))
    return F.concat_ws(
        "&",
        F.when(c("auto_orient"), "autoOrient=true"), pair("background", background), pair("blur", number_text(c("blur"))),
        pair("crop", crop), pair("fit", F.coalesce(c("fit"), F.lit("contain")), boxed), pair("format", fmt),
        pair("height", c("height").cast("string")), pair("optimize", c("optimize"), c("optimize") != "none"),
        pair("position", F.coalesce(c("position"), F.lit("center")), boxed), F.when(c("preserve_exif"), "preserveExif=true"),
        pair("quality", c("quality").cast("string")), pair("targetQuality", target),
        pair("rotate", c("rotate").cast("string"), c("rotate") != 0), pair("sharpen", number_text(c("sharpen"))),
        F.when(c("strip_metadata"), "stripMetadata=true"), pair("width", c("width").cast("string")),
    )


def cache_key(source: Column, params: Column, accept: Column | None = None, watermark: Column | None = None) -> Column:
    blank = F.lit("")
    return F.sha2(F.concat_ws("\n", source, params, blank if accept is None else F.coalesce(accept, blank), blank if watermark is None else F.coalesce(watermark, blank)), 256)


def watermark_identity(url: Column, position: Column, opacity: Column, margin: Column, kind: str = "watermark") -> Column:
    return F.sha2(F.concat_ws("\n", F.lit(kind), url, position, opacity.cast("string"), margin.cast("string")), 256)


def version_hash(kind: Column, reference: Column, version: Column, root: str, strict: bool = True, backend: str = "filesystem") -> Column:
    """Identity of a versioned source; null without a version."""
    text = F.concat_ws("\n", kind, reference, version, F.lit(root), F.lit("strict" if strict else "insecure"), F.lit(backend))
    return F.when(version.isNotNull(), F.sha2(text, 256))


def shard(key: Column) -> Column:
    """The folder of an entry: three levels of two digits."""
    return F.concat_ws("/", F.substring(key, 1, 2), F.substring(key, 3, 2), F.substring(key, 5, 2), key)


def lookup(requests: DataFrame, cache: DataFrame, ttl: int) -> DataFrame:
    """``requests`` (key, now) with ``state`` hit, stale or miss, and the age of a hit.  ``cache`` has key and mtime."""
    entries = cache.select(F.col("key").alias("entry_key"), "mtime")
    age = F.col("now") - F.col("mtime")
    joined = requests.join(entries, requests["key"] == entries["entry_key"], "left")
    return joined.select(
        *requests.columns,
        F.when(F.col("entry_key").isNull(), "miss").when(age <= ttl, "hit").otherwise("stale").alias("state"),
        F.when(age <= ttl, age).alias("age"),
    )


def evict(entries: DataFrame, max_bytes: int, parts: int | None = None) -> DataFrame:
    """Entries ``(key, size, mtime)`` with ``evicted``: the oldest go until the rest fits; 0 means no limit."""
    total = entries.agg(F.sum("size").alias("total_"))
    ranked = running_sum(entries, [], ["mtime", "key"], "size", "before_", parts)
    gone = (F.lit(max_bytes) > 0) & (F.col("total_") - F.col("before_") > max_bytes)
    return ranked.crossJoin(F.broadcast(total)).withColumn("evicted", gone).drop("before_", "total_")
