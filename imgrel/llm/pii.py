"""Operator 2: format-preserving Feistel pseudonyms for personal data.

Cards (Luhn), IBANs (mod 97), social security numbers, phone numbers, IPv4
addresses, dates and the local parts of e-mail addresses are found by one
pattern, validated, and permuted by keyed Feistel networks within their
format.  The permutation depends on the value alone, so equal values stay
linked across documents, however they are punctuated; what does not validate
stays as it is.  Dates and social security numbers are pairs of numbers below
two bounds whose product is the size of their domain, and the network adds
modulo each in turn, so it is one to one without leaving the domain.

All of it is DataFrame functions; a text without a digit or ``@`` is not
looked at further, and no row is shuffled.  The pattern repeats single
characters only, never groups without a bound, so that a text of any length
needs no stack.
"""

from __future__ import annotations

import secrets
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table

#: The session's setting that holds the key.
SETTING = "spark.imgrel.pii.key"
ROUNDS = 8
#: Signs of a string that one network permutes; a longer one is permuted in blocks.
BLOCK = 64
#: 400 years, a whole number of weeks, as days and as two factors.
FIRST_DAY, DAYS, DATE_BOUNDS = "1800-01-01", 146_097, (189, 773)
#: Areas but 000, 666 and 900 to 999; groups but 00 by serials but 0000.
SSN_BOUNDS = (898, 99 * 9999)

EMAIL = (
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?=[A-Za-z0-9-]++\.[A-Za-z0-9-])"
    r"[A-Za-z0-9.-]+?(?=\.\.|\.?(?![A-Za-z0-9.-]))"
)
IPV4 = r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"
DATE = r"(?<![0-9./-])(?:[0-9]{4}([-/.])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([-/.])[0-9]{1,2}\2[0-9]{4})(?![0-9]|[./-][0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])"
CARD = (
    r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\3[0-9]{4}\3[0-9]{1,7}|[0-9]{4}([ -])[0-9]{6}\4[0-9]{5})(?![0-9])"
)
PHONE = (
    r"(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,3}"
    r"|(?<![0-9.-])\(?[2-9][0-9]{2}\)?[ .-][0-9]{3}[ .-][0-9]{4})(?![0-9])"
)
#: Signs of an IBAN by country.
IBAN_SIGNS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "AO CV GW LY MZ PT ST", 26: "DZ IR IS TR", 27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD",
    28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU",
}


def _iban_pattern() -> str:
    """A country's number of signs, so that no token after them is taken in; else 12 to 35 signs."""
    forms = []
    for n, codes in IBAN_SIGNS.items():
        groups, rest = divmod(n - 4, 4)
        tail = f" ?[A-Z0-9]{{{rest}}}" if rest else ""
        forms.append(f"(?:{'|'.join(codes.split())})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{groups}}}{tail}(?![A-Za-z0-9])")
    forms.append("[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
    return rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{'|'.join(forms)})"


IBAN = _iban_pattern()
FIND = "|".join((EMAIL, IPV4, DATE, SSN, CARD, PHONE, IBAN))


@lru_cache(maxsize=None)
def _drawn(application: str) -> str:
    return secrets.token_hex(32)


def session_key(spark: SparkSession) -> str:
    """The key in the session's setting ``spark.imgrel.pii.key``.

    Where there is none, one is drawn for the application and forgotten with
    it: values are linked across all that it writes, and nobody can undo it.
    """
    return spark.conf.get(SETTING, None) or _drawn(spark.sparkContext.applicationId)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _char(text: Column, at: Column) -> Column:
    return text.substr(at, F.lit(1))


def _hex_number(text: Column, start: Column | int, digits: int) -> Column:
    start = F.lit(start) if isinstance(start, int) else start
    return F.conv(text.substr(start, F.lit(digits)), 16, 10).cast("long")


def _shift(text: Column, stream: Column) -> Column:
    """Move each digit and ASCII letter within its class by four hex digits of ``stream``."""

    def moved(at: Column) -> Column:
        char = _char(text, at)
        code, by = F.ascii(char), _hex_number(stream, at * 4 - 3, 4)
        turn = lambda first, n: F.char((code - first + by) % n + first)
        return (
            F.when(code.between(48, 57), turn(48, 10)).when(code.between(97, 122), turn(97, 26))
            .when(code.between(65, 90), turn(65, 26)).otherwise(char)
        )

    moved_all = F.array_join(F.transform(F.sequence(F.lit(1), F.length(text)), moved), "")
    return F.when(F.length(text) == 0, F.lit("")).otherwise(moved_all)


def permute_text(text: Column, kind: str | Column, key: str) -> Column:
    """A keyed permutation of strings of up to 64 digits and ASCII letters.

    A Feistel network over the two halves of the string; every sign stays in
    its class (digit, lower case, upper case), others stay where they are.
    """

    def run(value: Column) -> Column:
        half = (F.length(value) / 2).cast("int")
        start = F.struct(
            value.substr(F.lit(1), half).alias("a"), value.substr(half + 1, F.length(value)).alias("b")
        )

        def step(acc: Column, i: Column) -> Column:
            stream = F.sha2(F.concat_ws("|", F.lit(key), kind if isinstance(kind, Column) else F.lit(kind), i.cast("string"), F.length(value).cast("string"), acc["b"]).cast("binary"), 512)
            return F.struct(acc["b"].alias("a"), let(stream, lambda s: _shift(acc["a"], s)).alias("b"))

        return F.aggregate(
            F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda acc: F.concat(acc["a"], acc["b"])
        )

    return let(text, run)


def permute_number(number: Column, bounds: tuple[int, int], kind: str, key: str) -> Column:
    """A keyed permutation of the integers below the product of two bounds.

    A number is a pair below them; each round adds a hash of the one to the
    other, modulo the other's bound.
    """
    start = F.struct((number / F.lit(bounds[1])).cast("long").alias("a"), (number % bounds[1]).alias("b"))

    def step(acc: Column, i: Column) -> Column:
        def mixed(value: Column) -> Column:
            text = F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), value.cast("string"))
            return _hex_number(F.sha2(text.cast("binary"), 256), 1, 15)

        even = i % 2 == 0
        new = let(mixed(F.when(even, acc["b"]).otherwise(acc["a"])), lambda h: F.when(
            even, F.struct(((acc["a"] + h) % bounds[0]).alias("a"), acc["b"].alias("b"))
        ).otherwise(F.struct(acc["a"].alias("a"), ((acc["b"] + h) % bounds[1]).alias("b"))))
        return new

    return F.aggregate(
        F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda acc: acc["a"] * bounds[1] + acc["b"]
    )


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _refill(form: Column, signs: Column, pattern: str = "[0-9]") -> Column:
    """``form`` with the characters that match ``pattern`` replaced by ``signs`` in turn."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def step(acc: Column, char: Column) -> Column:
        taken = char.rlike(pattern)
        return F.struct(
            F.concat(acc["out"], F.when(taken, _char(signs, acc["at"])).otherwise(char)).alias("out"),
            (acc["at"] + taken.cast("int")).alias("at"),
        )

    return F.aggregate(F.filter(F.split(form, ""), lambda c: c != ""), start, step, lambda acc: acc["out"])


def luhn_sum(digits: Column, doubled: int) -> Column:
    """The Luhn sum; every second digit is doubled, counted from the right, the first (1) or the second (0)."""

    def step(acc: Column, i: Column) -> Column:
        digit = _char(digits, F.length(digits) - i + 1).cast("int")
        twice = F.when(digit > 4, digit * 2 - 9).otherwise(digit * 2)
        return acc + F.when(i % 2 == doubled, twice).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step)


def _card(match: Column, key: str) -> Column:
    def run(digits: Column) -> Column:
        body = permute_text(digits.substr(F.lit(1), F.length(digits) - 1), "card", key)
        new = let(body, lambda b: F.concat(b, ((10 - luhn_sum(b, 1) % 10) % 10).cast("string")))
        return F.when(luhn_sum(digits, 0) % 10 == 0, _refill(match, new)).otherwise(match)

    return let(_digits(match), run)


def mod97(text: Column) -> Column:
    """The remainder by 97 of a string whose letters stand for 10 to 35."""

    def step(acc: Column, char: Column) -> Column:
        code = F.ascii(char)
        return F.when(code >= 65, (acc * 100 + code - 55) % 97).otherwise((acc * 10 + code - 48) % 97)

    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0), step)


def _iban(match: Column, key: str) -> Column:
    def run(signs: Column) -> Column:
        country, body = signs.substr(F.lit(1), F.lit(2)), signs.substr(F.lit(5), F.length(signs))
        new = let(permute_text(body, "iban", key), lambda b: F.concat(
            country, F.lpad((98 - mod97(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0"), b
        ))
        valid = mod97(F.concat(body, signs.substr(F.lit(1), F.lit(4)))) == 1
        return F.when(valid, _refill(match, new, "[A-Z0-9]")).otherwise(match)

    return let(F.replace(match, F.lit(" "), F.lit("")), run)


def _ssn_valid(digits: Column) -> Column:
    area = digits.substr(F.lit(1), F.lit(3))
    return ~area.isin("000", "666") & (area < "900") & (digits.substr(F.lit(4), F.lit(2)) != "00") & (
        digits.substr(F.lit(6), F.lit(4)) != "0000"
    )


def _ssn(match: Column, key: str) -> Column:
    def run(digits: Column) -> Column:
        part = lambda at, n: digits.substr(F.lit(at), F.lit(n)).cast("long")
        area, group, serial = part(1, 3), part(4, 2), part(6, 4)
        place = area - 1 - (area > 666).cast("long")
        number = place * SSN_BOUNDS[1] + (group - 1) * 9999 + serial - 1

        def text(new: Column) -> Column:
            place, rest = (new / SSN_BOUNDS[1]).cast("long"), new % SSN_BOUNDS[1]
            area = place + 1 + (place >= 665).cast("long")
            pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
            return F.concat(pad(area, 3), pad((rest / 9999).cast("long") + 1, 2), pad(rest % 9999 + 1, 4))

        new = let(permute_number(number, SSN_BOUNDS, "ssn", key), text)
        return F.when(_ssn_valid(digits), _refill(match, new)).otherwise(match)

    return let(_digits(match), run)


def _phone(match: Column, key: str) -> Column:
    def run(digits: Column) -> Column:
        """The last ten digits are permuted, a country code before them stays."""
        n = F.length(digits)
        before = F.greatest(n - 10, F.lit(0))
        new = F.concat(digits.substr(F.lit(1), before), permute_text(digits.substr(before + 1, n), "phone", key))
        return F.when(n.between(8, 15), _refill(match, new)).otherwise(match)

    return let(_digits(match), run)


def _ipv4(match: Column, key: str) -> Column:
    def run(parts: Column) -> Column:
        number = F.aggregate(parts, F.lit(0).cast("long"), lambda acc, p: acc * 256 + p)
        new = let(permute_number(number, (1 << 16, 1 << 16), "ipv4", key), lambda x: F.concat_ws(
            ".", *(F.shiftright(x, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0))
        ))
        return F.when(F.forall(parts, lambda p: p < 256), new).otherwise(match)

    return let(F.transform(F.split(match, r"\."), lambda p: p.cast("long")), run)


def _date(match: Column, key: str) -> Column:
    def run(parts: Column) -> Column:
        first, second, third = (parts[k] for k in range(3))
        year_first = F.length(first) == 4
        # day before month, unless only the other way round gives a date
        swapped = ~year_first & (second.cast("int") > 12)
        year = F.when(year_first, first).otherwise(third)
        month = F.when(year_first | ~swapped, second).otherwise(first)
        day = F.when(year_first, third).when(swapped, second).otherwise(first)
        date = F.concat_ws("-", year, month, day).try_cast("date")
        number = F.datediff(date, F.lit(FIRST_DAY).cast("date")).cast("long")
        new = let(
            F.date_add(F.lit(FIRST_DAY).cast("date"), permute_number(number, DATE_BOUNDS, "date", key).cast("int")),
            lambda d: let(F.array(
                F.lpad(F.year(d).cast("string"), 4, "0"), F.month(d).cast("string"), F.dayofmonth(d).cast("string")
            ), lambda ymd: F.concat(
                _padded(F.when(year_first, ymd[0]).when(swapped, ymd[1]).otherwise(ymd[2]), first), _char(match, F.length(first) + 1),
                _padded(F.when(year_first, ymd[1]).when(swapped, ymd[2]).otherwise(ymd[1]), second), _char(match, F.length(first) + 1),
                _padded(F.when(year_first, ymd[2]).otherwise(ymd[0]), third),
            )),
        )
        return F.when(date.isNotNull() & number.between(0, DAYS - 1), new).otherwise(match)

    return let(F.split(match, "[-/.]"), run)


def _padded(text: Column, like: Column) -> Column:
    return F.lpad(text, F.greatest(F.length(text), F.length(like)), F.lit("0"))


def _email(match: Column, key: str) -> Column:
    """The local part is permuted, in blocks where it is long; the domain stays."""
    local, domain = F.substring_index(match, "@", 1), F.substring_index(match, "@", -1)
    blocks = F.regexp_extract_all(local, F.lit(f"[^@]{{1,{BLOCK}}}"), F.lit(0))
    new = F.array_join(F.transform(
        blocks, lambda b, i: permute_text(b, F.concat(F.lit("email"), F.when(i == 0, "").otherwise(i.cast("string"))), key)
    ), "")
    return F.concat(new, F.lit("@"), domain)


def pseudonym(match: Column, key: str) -> Column:
    """The pseudonym of one match of ``FIND``; the match itself if it does not validate."""
    whole = lambda pattern: match.rlike(f"^(?:{pattern})$")
    return (
        F.when(F.contains(match, F.lit("@")), _email(match, key))
        .when(whole(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"), _ipv4(match, key))
        .when(whole(r"[0-9]+[-/.][0-9]{1,2}[-/.][0-9]+") & ~whole(r"[0-9]{3}-[0-9]{2}-[0-9]{4}"), _date(match, key))
        .when(whole(r"[0-9]{3}-[0-9]{2}-[0-9]{4}"), _ssn(match, key))
        .when(whole(r"[A-Z]{2}.*"), _iban(match, key))
        .when(match.rlike(r"^[+(]") | whole(r"[0-9]{3}.[0-9]{3}.[0-9]{4}"), _phone(match, key))
        .otherwise(_card(match, key))
    )


def pseudonymize(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with its text pseudonymised and a last column ``n_pseudonyms``.

    Whole texts are searched.  A null text stays null and an empty one empty,
    both with count 0; repeated rows get equal results; other columns pass
    through, but for one named ``n_pseudonyms``, which is replaced, and
    ``n_chars``, which follows the new text where it changed.
    """
    column = F.col(f"`{text}`")
    found = F.regexp_extract_all(column, F.lit(FIND), F.lit(0))
    matches = F.transform(found, lambda m: F.struct(m.alias("old"), pseudonym(m, key).alias("new")))

    def rebuild(pairs: Column) -> Column:
        parts = F.zip_with(
            F.split(column, FIND, -1), pairs, lambda gap, pair: F.concat(gap, F.coalesce(pair["new"], F.lit("")))
        )
        changed = F.filter(pairs, lambda p: p["old"] != p["new"])
        return F.struct(F.array_join(parts, "").alias("text"), F.size(changed).cast("long").alias("n"))

    as_it_is = F.struct(column.alias("text"), F.lit(0).cast("long").alias("n"))
    done = F.when(column.rlike("[0-9@]"), let(matches, rebuild)).otherwise(as_it_is)
    names = [c for c in docs.columns if c != "n_pseudonyms"]
    out = docs.select(*(F.col(f"`{c}`") for c in names), done.alias("n_pseudonyms"))
    kept = [
        F.col("n_pseudonyms.text").alias(c) if c == text
        else F.when(F.col("n_pseudonyms.n") > 0, F.length("n_pseudonyms.text")).otherwise(F.col(c)).cast(docs.schema[c].dataType).alias(c)
        if c == "n_chars" else F.col(f"`{c}`")
        for c in names
    ]
    return out.select(*kept, F.col("n_pseudonyms.n").alias("n_pseudonyms"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymize(table(spark, sf_dir, "documents").select("doc_id", "text"), session_key(spark))
