"""IPv6 literals: their digits, and whether a remote URL may point to them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .urls import DENIED, address, within

#: Groups with at most one gap; how many there are is not judged.
FORM = "^([0-9a-f]{1,4}(:[0-9a-f]{1,4})*)?(::([0-9a-f]{1,4}(:[0-9a-f]{1,4})*)?)?\\z"
#: The most characters of a literal, with a dotted tail.
LONGEST = 45


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def digits(text: Column) -> Column:
    """The 32 hexadecimal digits of a literal, a dotted tail included; null if the text is none."""

    def plain(parts: Column) -> Column:
        """With the dotted tail as two groups."""
        text, tail = parts["text"], parts["tail"]
        return _let(address(tail), lambda number: F.when(tail == "", text).otherwise(F.concat(
            F.substr(text, F.lit(1), F.length(text) - F.length(tail)), F.lower(F.hex(F.shiftright(number, 16))), F.lit(":"), F.lower(F.hex(number % 65536))
        )))

    def padded(text: Column) -> Column:
        """Groups of four digits each, then zeros for the gap."""
        four = F.regexp_replace(F.regexp_replace(text, "([0-9a-f]+)", "000$1"), "[0-9a-f]*([0-9a-f]{4})", "$1")

        def filled(four: Column) -> Column:
            digits = F.length(F.replace(four, F.lit(":"), F.lit("")))
            gap = F.contains(four, F.lit("::"))
            full = F.replace(F.replace(four, F.lit("::"), F.repeat(F.lit("0"), 32 - digits)), F.lit(":"), F.lit(""))
            return F.when(F.when(gap, digits < 32).otherwise(digits == 32), full)

        return F.when(text.rlike(FORM), _let(four, filled))

    parts = F.struct(F.lower(text).alias("text"), F.regexp_extract(text, r"([0-9]+(?:\.[0-9]+){3})$", 1).alias("tail"))
    likely = F.contains(text, F.lit(":")) & (F.length(text) <= LONGEST)
    return F.when(likely, F.when(F.contains(text, F.lit(".")), _let(_let(parts, plain), padded)).otherwise(_let(F.lower(text), padded)))


def denied_digits(d: Column) -> Column:
    """Whether an address of 32 digits is local, reserved, or carries an IPv4 address that is denied; null for null."""

    def carried(at: int) -> Column:
        def run(number: Column) -> Column:
            out = F.lit(False)
            for base, bits in DENIED:
                out = out | within(number, base, bits)
            return out

        return _let(F.conv(F.substring(d, at, 8), 16, 10).cast("long"), run)

    return (
        F.when(d.rlike("^(0{31}[01]|ff.*)$"), True).when(d.rlike("^0{20}(ffff|0000)"), carried(25)).when(d.rlike("^2002"), carried(5))
        .otherwise(d.rlike("^(20010000|20010db8|f[cd]|fe[89ab])"))
    )


def is_denied(text: Column) -> Column:
    """As ``denied_digits`` of a literal; false for anything that is none."""
    return F.coalesce(_let(digits(text), denied_digits), F.lit(False))
