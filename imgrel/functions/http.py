"""Raw HTTP requests, multipart bodies and configured headers, parsed by built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
MAX_HEADER_BYTES = 16 * 1024
SINGLETONS = ("host", "authorization", "content-length", "content-type", "transfer-encoding")
DENIED_HEADERS = (
    "content-length", "transfer-encoding", "content-encoding", "content-type", "connection", "host", "upgrade", "proxy-connection",
    "keep-alive", "te", "trailer",
)


def request(raw: Column, max_body: int) -> Column:
    """``(method, target, version, headers, body, status, error)`` of a request; headers as pairs, names in lower case."""
    end = F.instr(raw, "\r\n\r\n")
    head = F.when(end > 0, F.substr(raw, F.lit(1), end - 1)).otherwise(raw)
    lines = F.split(head, "\r\n")
    words = F.filter(F.split(F.get(lines, 0), r"\s+"), lambda w: w != "")
    rest = F.filter(F.slice(lines, 2, 10_000), lambda x: x != "")
    name = lambda x: F.substring_index(x, ":", 1)
    headers = F.transform(rest, lambda x: F.struct(F.lower(name(x)).alias("name"), F.trim(F.substr(x, F.instr(x, ":") + 1)).alias("value")))
    values = lambda wanted: F.transform(F.filter(headers, lambda h: h["name"] == wanted), lambda h: h["value"])
    length = F.get(values("content-length"), 0)
    number = F.when(length.isNull(), 0).otherwise(F.when(length.rlike(r"^\+?[0-9]+$"), length.try_cast("long")))
    body = F.substr(raw, end + 4)
    rules = [
        (end == 0, 400, F.lit("request ended before the HTTP headers were complete")),
        (F.octet_length(head) > MAX_HEADER_BYTES, 413, F.lit("request headers are too large")),
        (F.size(words) == 0, 400, F.lit("request line is missing an HTTP method")),
        (F.size(words) == 1, 400, F.lit("request line is missing a target path")),
        (F.size(words) == 2, 400, F.lit("request line is missing an HTTP version")),
        (F.size(words) > 3, 400, F.lit("request line has too many fields")),
        (F.exists(rest, lambda x: F.instr(x, ":") == 0), 400, F.lit("request headers must use `name: value` syntax")),
        (F.exists(rest, lambda x: (name(x) == "") | (name(x) != F.trim(name(x)))), 400, F.lit("header name must not be empty or contain leading/trailing whitespace")),
        *((F.size(values(s)) > 1, 400, F.lit(f"duplicate `{s}` header is not allowed")) for s in SINGLETONS),
        (F.size(values("transfer-encoding")) > 0, 501, F.lit("Transfer-Encoding is not supported; use Content-Length instead")),
        (number.isNull(), 400, F.lit("content-length must be a non-negative integer")),
        (number > max_body, 413, F.lit("request body is too large")),
        (F.octet_length(body) < number, 400, F.lit("request ended before the body was complete")),
    ]
    outcome = F.coalesce(*(F.when(bad, F.struct(F.lit(status).alias("status"), text.alias("error"))) for bad, status, text in rules))
    return F.struct(
        F.get(words, 0).alias("method"), F.get(words, 1).alias("target"), F.get(words, 2).alias("version"), headers.alias("headers"),
        F.substr(body, F.lit(1), F.coalesce(number, F.lit(0)).cast("int")).alias("body"),
        F.coalesce(outcome["status"], F.lit(200)).cast("long").alias("status"), outcome["error"].alias("error"),
    )


def multipart(body: Column, boundary: Column) -> Column:
    """``(parts, error)`` of a text body; each part has a name, a content type and its content."""
    opening = F.concat(F.lit("--"), boundary)
    pieces = F.split(F.concat(F.lit("\r\n"), body), F.concat(F.lit(r"\r\n\Q"), opening, F.lit(r"\E")), -1)
    inner = F.slice(pieces, 2, F.greatest(F.size(pieces) - 2, F.lit(0)))
    last = F.element_at(pieces, -1)

    def part(piece: Column) -> Column:
        head = F.substring_index(F.substr(piece, F.lit(3)), "\r\n\r\n", 1)
        kind = F.regexp_extract(head, r"(?im)^content-type:\s*([^\r\n]+)", 1)
        return F.struct(
            F.regexp_extract(head, r'(?i)[;\s]name="([^"]*)"', 1).alias("name"), F.when(kind != "", kind).alias("content_type"),
            F.substr(piece, F.instr(piece, "\r\n\r\n") + 4).alias("content"),
        )

    error = (
        F.when(~F.startswith(body, opening), "multipart body does not start with the declared boundary")
        .when(~F.startswith(last, F.lit("--")), "multipart boundary sequence is malformed")
        .when(~last.isin("--", "--\r\n"), "multipart closing boundary has unexpected trailing data")
        .when(F.exists(inner, lambda p: ~F.startswith(p, F.lit("\r\n"))), "multipart boundary must be followed by CRLF")
    )
    return F.struct(F.when(error.isNull(), F.transform(inner, part)).alias("parts"), error.alias("error"))


def upload_error(parts: Column) -> Column:
    """What is wrong with the fields of an upload, if anything."""
    known = ("file", "options", "watermark", "watermark_position", "watermark_opacity", "watermark_margin")
    names = F.transform(parts, lambda p: p["name"])
    content = lambda n: F.get(F.transform(F.filter(parts, lambda p: p["name"] == n), lambda p: p["content"]), 0)
    return (
        F.when(F.exists(names, lambda n: ~n.isin(*known)), "unknown multipart field")
        .when(F.size(F.array_distinct(names)) < F.size(names), "duplicate multipart field")
        .when(~F.array_contains(names, "file"), "multipart upload requires a `file` field")
        .when(content("file") == "", "`file` must not be empty")
        .when(F.exists(names, lambda n: F.startswith(n, F.lit("watermark_"))) & ~F.array_contains(names, "watermark"), "watermark fields require `watermark`")
    )


def encodings_allowed(header: Column) -> Column:
    """Whether a Content-Encoding names nothing but gzip, br and identity."""
    names = F.filter(F.transform(F.split(header, ","), lambda s: F.trim(s)), lambda s: s != "")
    return F.coalesce(F.forall(names, lambda s: s.isin("gzip", "br", "identity")), F.lit(True))


def header_error(name: Column, value: Column) -> Column:
    """Why a configured response header is refused."""
    return (
        F.when(name == "", "header name must not be empty")
        .when(~name.rlike(r"^[A-Za-z0-9!#$%&'*+.^_`|~-]+$"), "invalid character in header name")
        .when(F.lower(name).isin(*DENIED_HEADERS), "framing header")
        .when(~value.rlike(r"^[\t\x20-\x7E]*$"), "invalid character in value")
    )


def compressible(content_type: Column, size: Column) -> Column:
    """Whether a response may be compressed: text or JSON of at least 128 bytes."""
    kind = F.lower(F.trim(F.substring_index(content_type, ";", 1)))
    return (size >= 128) & (F.startswith(kind, F.lit("text/")) | kind.isin("application/json", "application/problem+json"))
