"""Signed URLs: canonical queries, HMAC-SHA256 from built-in functions, verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The names that a public query may hold.
ALLOWED = (
    "autoOrient", "background", "blur", "crop", "expires", "fit", "format", "height", "keyId", "optimize", "path", "position",
    "preserveExif", "preset", "quality", "rotate", "sharpen", "signature", "stripMetadata", "targetQuality", "url", "version",
    "watermarkMargin", "watermarkOpacity", "watermarkPosition", "watermarkUrl", "width",
)


def canonical_query(query: Column) -> Column:
    """A map as a form-encoded query, sorted by name, without the signature."""
    entries = F.array_sort(F.map_entries(query))
    kept = F.filter(entries, lambda e: e["key"] != "signature")
    return F.array_join(F.transform(kept, lambda e: F.concat(F.url_encode(e["key"]), F.lit("="), F.url_encode(e["value"]))), "&")


def canonical(method: Column, authority: Column, path: Column, query: Column) -> Column:
    return F.concat_ws("\n", method, authority, path, canonical_query(query))


def hmac_sha256(key: Column, message: Column) -> Column:
    """Lower-case hexadecimal HMAC of two strings.

    Pads are eight numbers of eight bytes, each with a constant: for a literal
    key Spark folds them away.
    """
    raw = key.cast("binary")
    short = F.when(F.octet_length(raw) > 64, F.unhex(F.sha2(raw, 256))).otherwise(raw)
    padded = F.rpad(F.hex(short), 128, "0")

    def pad(value: int) -> Column:
        constant = F.lit(int.from_bytes(bytes([value]) * 8))
        numbers = (F.conv(F.substring(padded, 16 * k + 1, 16), 16, -10).cast("long") for k in range(8))
        return F.unhex(F.concat(*(F.lpad(F.hex(x.bitwiseXOR(constant)), 16, "0") for x in numbers)))

    inner = F.unhex(F.sha2(F.concat(pad(0x36), message.cast("binary")), 256))
    return F.sha2(F.concat(pad(0x5C), inner), 256)


def verify(requests: DataFrame, keys: DataFrame, now: int) -> DataFrame:
    """Requests with the status of their signature.

    ``requests`` has method, authority, path, query (a map with keyId, expires
    and signature); ``keys`` has key_id and secret.  401 for an unknown key, a
    late or a wrong signature; 400 for an ``expires`` that is no whole number.
    The second in which it expires is still valid.
    """
    get = lambda name: F.try_element_at("query", F.lit(name))
    expires = F.when(get("expires").rlike("^[+]?[0-9]+$"), get("expires").try_cast("long"))
    joined = requests.join(keys, get("keyId") == keys["key_id"], "left")
    good = hmac_sha256(F.col("secret"), canonical(F.col("method"), F.col("authority"), F.col("path"), F.col("query")))
    status = (
        F.when(get("keyId").isNull() | get("expires").isNull() | get("signature").isNull(), 401)
        .when(F.col("key_id").isNull(), 401).when(expires.isNull(), 400).when(expires < now, 401)
        .when(F.lower(get("signature")) == good, 200).otherwise(401)
    )
    return joined.select(*requests.columns, status.cast("long").alias("status"))


def stable_expiry(now: Column, ttl: int) -> Column:
    """The end of the window of ``ttl`` seconds that holds ``now``, so URLs made in it are alike."""
    return (F.ceil(now / ttl) * ttl).cast("long")


def bearer_token(header: Column) -> Column:
    """The token of an Authorization header; null for another scheme or none."""
    scheme, token = F.regexp_extract(header, r"^(\S*+)\s", 1), F.trim(F.regexp_extract(header, r"(?s)^\S*+\s(.*)$", 1))
    return F.when((F.lower(scheme) == "bearer") & (token != ""), token)


def bearer_status(header: Column, expected: Column) -> Column:
    """503 where no token is configured, 401 for a missing or another one, else 200."""
    return F.when(expected.isNull(), 503).when(F.coalesce(bearer_token(header) == expected, F.lit(False)), 200).otherwise(401).cast("long")
