"""Rules for remote URLs, addresses, storage paths and object keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .media import MAX_KEY_BYTES

# IPv4 ranges that a remote URL must not point to, as address and prefix length.
DENIED = (
    ("0.0.0.0", 32), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12),
    ("192.0.2.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24),
    ("224.0.0.0", 4), ("240.0.0.0", 4),
)
IPV4 = r"^(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(\.(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])){3}$"


def address(text: Column) -> Column:
    """An IPv4 address as a number; null if the text is none."""
    second, third = F.substring_index(F.substring_index(text, ".", 2), ".", -1), F.substring_index(F.substring_index(text, ".", -2), ".", 1)
    number = F.lit(0).cast("long")
    for part in (F.substring_index(text, ".", 1), second, third, F.substring_index(text, ".", -1)):
        number = number * 256 + part.try_cast("long")
    return F.when(text.rlike(IPV4), number)


def _number(text: str) -> int:
    total = 0
    for part in text.split("."):
        total = total * 256 + int(part)
    return total


def within(number: Column, base: str, bits: int) -> Column:
    first = _number(base) >> (32 - bits) << (32 - bits)
    return number.between(first, first + (1 << (32 - bits)) - 1)


def is_denied(text: Column) -> Column:
    """Whether a literal IPv4 address lies in a denied range; false for anything else."""
    number, out = address(text), F.lit(False)
    for base, bits in DENIED:
        out = out | within(number, base, bits)
    return F.coalesce(out, F.lit(False))


def host_address(host: Column) -> Column:
    """The IPv4 address that browsers read in a host, as a number; -1 if it has the form of one but is none; else null.

    The last label decides: a number in decimal, octal or hexadecimal makes
    all labels numbers, of which the last fills the bytes that are left.
    """
    labels = F.split(host, r"\.", -1)
    last = F.element_at(labels, -1)

    def number(label: Column) -> Column:
        digits = F.when(label.rlike("^0x"), F.regexp_replace(label, "^0x0*", "")).otherwise(F.regexp_replace(label, "^0+", ""))
        value = (
            F.when(~label.rlike("^(0x[0-9a-f]*|0[0-7]*|[1-9][0-9]*)$") | (F.length(digits) > 12), F.lit(None))
            .when(digits == "", "0").when(label.rlike("^0x"), F.conv(digits, 16, 10)).when(label.rlike("^0"), F.conv(digits, 8, 10)).otherwise(digits)
        )
        return value.cast("long")

    def whole(numbers: Column) -> Column:
        n = F.size(numbers)
        before = F.slice(numbers, 1, n - 1)
        left = F.element_at(F.array(*(F.lit(1 << (8 * k)) for k in (4, 3, 2, 1))), n)
        total = F.aggregate(before, F.lit(0).cast("long"), lambda acc, x: acc * 256 + x) * left + F.element_at(numbers, -1)
        good = F.forall(before, lambda x: x < 256) & (F.element_at(numbers, -1) < left)
        return F.when(F.coalesce(good, F.lit(False)), total).otherwise(F.lit(-1).cast("long"))

    numbers = F.transform(labels, number)
    found = F.when(F.size(labels) > 4, F.lit(-1).cast("long")).otherwise(F.element_at(F.transform(F.array(numbers), whole), 1))
    return F.when(last.rlike("^([0-9]+|0x[0-9a-f]*)$"), found)


def url_status(url: Column) -> Column:
    """The status that the policy gives a URL; names are not resolved.

    Hosts are read as browsers read them: percent-decoded, in lower case,
    without a closing dot, numbers as addresses, literals in brackets.  Signs
    outside ASCII that stand for digits or dots are refused.
    """
    from . import ipv6

    url = F.regexp_replace(F.regexp_replace(url, "^[\\x00-\\x20]++|[\\x00-\\x20]++$", ""), "[\\t\\n\\r]", "")
    scheme = F.lower(F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*+):", 1))
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*+:[/\\]*+([^/?#\\]*+)", 1)
    literal = F.regexp_extract(authority, r"^\[([^\]]*+)\](?::[0-9]*+)?$", 1)
    name = F.lower(F.coalesce(F.try_url_decode(F.replace(F.regexp_extract(authority, r"^([^:\[]*+)(?::[0-9]*+)?$", 1), F.lit("+"), F.lit("%2B"))), F.lit("")))
    name = F.regexp_replace(name, r"\.$", "")
    port = F.regexp_extract(authority, r":([0-9]+)$", 1)
    port = F.when(port == "", F.when(scheme == "https", 443).otherwise(80)).when(F.length(port) > 9, 65536).otherwise(port.try_cast("int"))
    facts = F.struct(
        scheme.alias("scheme"), authority.alias("authority"), ipv6.digits(literal).alias("digits"), name.alias("name"), port.alias("port"),
        host_address(name).alias("address"),
    )

    def status(x: Column) -> Column:
        denied = F.lit(False)
        for base, bits in DENIED:
            denied = denied | within(x["address"], base, bits)
        bracketed = F.startswith(x["authority"], F.lit("["))
        return (
            F.when(~x["scheme"].isin("http", "https"), 400).when(F.instr(x["authority"], "@") > 0, 400)
            .when(F.when(bracketed, x["digits"].isNull()).otherwise(x["name"] == ""), 400)
            .when(x["name"].rlike(r"[\p{N}\x{3002}\x{FF0E}\x{FF61}&&[^0-9]]"), 403)
            .when(x["name"].rlike(r"[\x00-\x20#%/:<>?@\[\\\]^|\x7F]"), 400).when((x["address"] == -1) | (x["port"] > 65535), 400)
            .when(x["name"].isin("169.254.169.254", "metadata.google.internal"), 403).when(~x["port"].isin(80, 443), 403)
            .when(F.coalesce(F.when(bracketed, ipv6.denied_digits(x["digits"])).otherwise(denied), F.lit(False)), 403).otherwise(200)
        )

    return F.element_at(F.transform(F.array(facts), status), 1).cast("long")


def client_address(peer: Column, forwarded: Column, real: Column, trusted: list[tuple[str, int]]) -> Column:
    """The rightmost forwarded address that is not a trusted proxy; else the real-ip header; else the peer."""

    def is_trusted(text: Column) -> Column:
        out = F.lit(False)
        for base, bits in trusted:
            out = out | within(address(text), base, bits)
        return F.coalesce(out, F.lit(False))

    usable = lambda c: c.rlike(IPV4) & ~is_trusted(c)
    hops = F.filter(F.transform(F.split(forwarded, ","), lambda x: F.trim(x)), usable)
    real = F.trim(real)
    found = F.coalesce(F.try_element_at(hops, F.lit(-1)), F.when(usable(real), real), peer)
    return F.when(is_trusted(peer), found).otherwise(peer)


def path_error(path: Column) -> Column:
    """Why a storage path is refused; null if it is not.

    Repeated separators, and a dot segment that is not the first, collapse.
    """
    trimmed = F.regexp_replace(path, "^/+", "")
    parts = F.split(trimmed, "/")
    return F.when(trimmed == "", "source path must not be empty").when(
        F.exists(parts, lambda p: p == "..") | (F.get(parts, 0) == "."),
        "source path must not contain root, current-directory, or parent-directory segments",
    )


def key_error(key: Column, store: str = "S3") -> Column:
    return (
        F.when(key == "", f"{store} key must not be empty")
        .when(key.rlike("[\\x00\\n\\r]"), f"{store} key contains invalid characters (null, newline, or carriage return)")
        .when(F.octet_length(key) > MAX_KEY_BYTES, f"{store} key exceeds the maximum allowed length of {MAX_KEY_BYTES} bytes")
    )


def object_url(scheme: Column, bucket: Column, default_bucket: str, key: Column) -> Column:
    return F.concat(scheme, F.lit("://"), F.coalesce(bucket, F.lit(default_bucket)), F.lit("/"), key)


def follow_redirects(start: DataFrame, hops: DataFrame, most: int = 5) -> DataFrame:
    """``start`` (id, url) followed through ``hops`` (src, status, location): at most ``most`` of them.

    Returns id, url, n_hops and status: 200 at a URL without a redirect, 502
    for a redirect without a location, 508 after too many.  Each step is one
    equi-join with the hops, which Spark may broadcast if they are few.
    """
    moved = hops.where(F.col("status").isin(301, 302, 303, 307, 308)).select(F.col("src").alias("hop_src"), "location")
    rows = start.select("id", "url", F.lit(0).cast("long").alias("n_hops"), F.lit(None).cast("long").alias("status"))
    for step in range(most + 1):
        known = rows.join(moved, (rows["url"] == moved["hop_src"]) & rows["status"].isNull(), "left")
        redirected = F.col("hop_src").isNotNull()
        status = F.when(F.col("status").isNotNull(), F.col("status")).when(~redirected, 200).when(
            F.col("location").isNull(), 502).when(F.lit(step == most), 508)
        goes_on = status.isNull()
        rows = known.select(
            "id", F.when(goes_on, F.col("location")).otherwise(F.col("url")).alias("url"),
            (F.col("n_hops") + F.when(goes_on, 1).otherwise(0)).cast("long").alias("n_hops"), status.cast("long").alias("status"),
        )
    return rows
