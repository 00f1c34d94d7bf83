"""Table functions for SQL: the parts of a file or a body as rows, joined LATERAL to the table that holds it.

Each reads one value and yields what it finds there; everything that is then
asked of the parts is SQL.  Offsets count from 0 in the value that was given.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


@udtf(returnType="marker int, at bigint, length bigint")
class JpegSegments:
    """Markers up to the scan or the end, with the lengths that they declare (null for those without); a broken file ends early."""

    def eval(self, content: bytes) -> Iterator[tuple]:
        at, size = 2, len(content or b"")
        while at + 2 <= size and content[at] == 0xFF:
            marker = content[at + 1]
            if marker == 0xFF:
                at += 1
            elif marker in (0xD9, 0xDA):
                yield marker, at, None
                return
            elif marker == 0x01 or 0xD0 <= marker <= 0xD7:
                yield marker, at, None
                at += 2
            else:
                length = int.from_bytes(content[at + 2 : at + 4])
                if length < 2 or at + 2 + length > size:
                    return
                yield marker, at, length
                at += 2 + length


@udtf(returnType="kind string, at bigint, length bigint")
class WebpChunks:
    """Chunks of a RIFF file with the lengths that they declare, padding left out; a chunk that is cut off ends the list."""

    def eval(self, content: bytes) -> Iterator[tuple]:
        at, size = 12, len(content or b"")
        while at + 8 <= size:
            length = int.from_bytes(content[at + 4 : at + 8], "little")
            if at + 8 + length > size:
                return
            yield content[at : at + 4].decode("latin-1"), at, length
            at += 8 + length + length % 2


@udtf(returnType="kind string, at bigint, body bigint, next bigint, error string")
class Boxes:
    """Boxes of one container one after another; ``error`` is in the last row where the container is broken.

    A size of 0 stands for the length of the whole container, so such a box
    fits only where it comes first.
    """

    def eval(self, content: bytes) -> Iterator[tuple]:
        content = content or b""
        at, size = 0, len(content)
        while at + 8 <= size:
            length, head, kind = int.from_bytes(content[at : at + 4]), 8, content[at + 4 : at + 8].decode("latin-1")
            if length == 0:
                length = size
            elif length == 1:
                if at + 16 > size:
                    yield kind, at, None, None, "extended mp4 box header is truncated"
                    return
                length, head = int.from_bytes(content[at + 8 : at + 16]), 16
            error = "mp4 box size is smaller than its header" if length < head else "mp4 box is too large" if at + length >= 1 << 64 else (
                "mp4 box exceeds file length" if at + length > size else None
            )
            if error:
                yield kind, at, None, None, error
                return
            yield kind, at, at + head, at + length, None
            at += length
        if at != size:
            yield None, at, None, None, "avif box payload has trailing bytes"


@udtf(returnType="place int, name string, filename string, content_type string, content binary, error string")
class MultipartParts:
    """The parts of a body of bytes, in order; one row with ``error`` alone where the body is malformed."""

    def eval(self, body: bytes, boundary: str) -> Iterator[tuple]:
        opening, body = b"--" + (boundary or "").encode(), body or b""
        if not body.startswith(opening):
            yield None, None, None, None, None, "multipart body does not start with the declared boundary"
            return
        pieces = (b"\r\n" + body).split(b"\r\n" + opening)[1:]
        *inner, last = pieces
        error = None
        if not last.startswith(b"--"):
            error = "multipart boundary sequence is malformed"
        elif last not in (b"--", b"--\r\n"):
            error = "multipart closing boundary has unexpected trailing data"
        elif not all(p.startswith(b"\r\n") for p in inner):
            error = "multipart boundary must be followed by CRLF"
        if error:
            yield None, None, None, None, None, error
            return
        for place, piece in enumerate(inner):
            head, _, content = piece[2:].partition(b"\r\n\r\n")
            text = head.decode("utf-8", "replace")
            found = {k: re.search(p, text) for k, p in self.FIELDS.items()}
            yield (place, *(m and m[1].strip() for m in found.values()), content, None)

    FIELDS = {
        "name": r'(?i)[;\s]name="([^"]*)"', "filename": r'(?i)[;\s]filename="([^"]*)"', "content_type": r"(?im)^content-type:\s*([^\r\n]+)",
    }


FUNCTIONS = {"jpeg_segments": JpegSegments, "webp_chunks": WebpChunks, "mp4_boxes": Boxes, "multipart_parts": MultipartParts}


def register(spark: SparkSession) -> None:
    """Make the functions known to the session's SQL."""
    for name, function in FUNCTIONS.items():
        spark.udtf.register(name, function)
