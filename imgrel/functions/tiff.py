"""Size and colour of a TIFF from the tags of its first directory, in either byte order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The tags that are read.
WIDTH, HEIGHT, PHOTOMETRIC, SAMPLES = 256, 257, 262, 277
SHORT = 3
#: A directory that starts later ends outside any binary value.
LAST = (1 << 31) - (1 << 20)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def header(content: Column) -> Column:
    """``(width, height, has_alpha)``; nulls where a tag is missing or lies outside ``content``.

    Each entry of the directory is cut out once, as hexadecimal text, and only
    those with a tag that is read become numbers.
    """
    return _let(content, lambda c: _let(F.hex(F.substring(c, 1, 8)), lambda start: _directory(c, start)))


def _directory(content: Column, start: Column) -> Column:
    little = F.startswith(start, F.lit("49492A00"))

    def number(text: Column, at: int, width: int) -> Column:
        """Of ``width`` bytes at byte ``at`` of a hexadecimal text; null if it is shorter."""
        byte = [F.substring(text, 2 * k + 1, 2) for k in range(at, at + width)]
        digits = F.when(little, F.concat(*reversed(byte))).otherwise(F.concat(*byte))
        return F.when(F.length(text) >= 2 * (at + width), F.conv(digits, 16, 10).cast("long"))

    def coded(tag: int) -> Column:
        return F.when(little, f"{tag % 256:02X}{tag // 256:02X}").otherwise(f"{tag:04X}")

    def value(entry: Column) -> Column:
        return F.when(number(entry, 2, 2) == SHORT, number(entry, 8, 2)).otherwise(number(entry, 8, 4))

    def read(first: Column) -> Column:
        count = F.coalesce(number(F.hex(F.substr(content, first + 1, F.lit(2))), 0, 2), F.lit(0)).cast("int")
        cut = F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.hex(F.substr(content, first + 3 + k * 12, F.lit(12))))
        known = F.filter(cut, lambda e: F.substring(e, 1, 4).isin(*map(coded, (WIDTH, HEIGHT, PHOTOMETRIC, SAMPLES))))
        return _let(F.when(count > 0, known), facts)

    def facts(entries: Column) -> Column:
        tag = lambda wanted: value(F.get(F.filter(entries, lambda e: F.substring(e, 1, 4) == coded(wanted)), 0))
        found = F.struct(tag(WIDTH).alias("width"), tag(HEIGHT).alias("height"), tag(PHOTOMETRIC).alias("photometric"), F.coalesce(tag(SAMPLES), F.lit(1)).alias("samples"))
        alpha = lambda f: ((f["photometric"] <= 1) & (f["samples"] == 2)) | ((f["photometric"] == 2) & (f["samples"] == 4))
        return _let(found, lambda f: F.struct(f["width"].alias("width"), f["height"].alias("height"), alpha(f).alias("has_alpha")))

    first = number(start, 4, 4)
    return _let(F.when(first <= LAST, first.cast("int")), read)
