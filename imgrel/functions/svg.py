"""Cleaning of vector images by a streaming parser, in Arrow batches."""

from __future__ import annotations

import re
from xml.parsers import expat

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Elements that are left out with all they hold, and limits.
FORBIDDEN = ("script", "foreignobject", "iframe", "embed", "object")
MAX_ELEMENTS = 100_000
MAX_DEPTH = 256

_IMPORT = re.compile(r"(?i)@import[^;]*+;?")
_URL = re.compile(r"(?i)url\(")
_PARENTHESIS = re.compile(r"[()]")
_HANDLER = re.compile(r"on[a-z]")


def is_dangerous_href(value: Column) -> Column:
    """Everything but nothing, fragments, and raster images in data URLs."""
    trimmed = F.trim(value)
    lower = F.lower(trimmed)
    return ~((trimmed == "") | F.startswith(trimmed, F.lit("#")) | (
        F.startswith(lower, F.lit("data:image/")) & ~F.startswith(lower, F.lit("data:image/svg"))
    ))


def _dangerous(value: str) -> bool:
    """As ``is_dangerous_href``, of one text."""
    plain = value.strip().lower()
    return not (not plain or plain[0] == "#" or (plain.startswith("data:image/") and not plain.startswith("data:image/svg")))


def css_text(css: str) -> str:
    """Without imports; ``url(...)``, up to the parenthesis that closes it, is emptied unless it is a fragment or a raster data URL."""
    css, out, at = _IMPORT.sub("", css), [], 0
    for opened in _URL.finditer(css):
        if opened.start() < at:
            continue
        depth, value, after = 0, None, len(css)
        for sign in _PARENTHESIS.finditer(css, opened.end()):
            depth += 1 if sign[0] == "(" else -1
            if depth < 0:
                value, after = css[opened.end():sign.start()], sign.end()
                break
        value = css[opened.end():] if value is None else value
        out += [css[at:opened.start()], "url()" if _dangerous(value.strip().strip("'\"")) else f"url({value})"]
        at = after
    return "".join(out) + css[at:]


def _escape(text: str, attribute: bool = False) -> str:
    text = text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    return text.replace('"', "&quot;").replace("\n", "&#10;").replace("\t", "&#9;") if attribute else text


class _Cleaner:
    """What is left of an image, written while it is parsed.

    Entities of its own are carried out, so that nothing comes in by them; the
    text of a style is judged as a whole, and elements inside it are left out.
    """

    def __init__(self, data: bytes):
        self.data, self.out, self.open, self.skipped, self.elements, self.depth = data, [], False, 0, 0, 0
        self.style, self.doctype, self.cdata = None, False, False
        p = self.parser = expat.ParserCreate()
        p.ordered_attributes, p.buffer_text = True, True
        p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler = self.start, self.end, self.text
        p.StartCdataSectionHandler, p.EndCdataSectionHandler = lambda: self.section(True), lambda: self.section(False)
        p.StartDoctypeDeclHandler, p.EndDoctypeDeclHandler, p.DefaultHandlerExpand = self.declared, self.undeclared, self.other

    def write(self, text: str) -> None:
        if self.open:
            self.out.append(">")
            self.open = False
        self.out.append(text)

    def declared(self, name, system, public, _) -> None:
        ids = f' PUBLIC "{public}" "{system}"' if public else f' SYSTEM "{system}"' if system else ""
        self.write(f"<!DOCTYPE {name}{ids}>")
        self.doctype = True

    def undeclared(self) -> None:
        self.doctype = False

    def start(self, name: str, attributes: list[str]) -> None:
        local = name.rpartition(":")[2].lower()
        if self.skipped or self.style is not None or local in FORBIDDEN:
            self.skipped += 1
            return
        self.elements, self.depth = self.elements + 1, self.depth + 1
        if self.elements > MAX_ELEMENTS:
            raise OverflowError(f"SVG exceeds maximum element count ({MAX_ELEMENTS})")
        if self.depth > MAX_DEPTH:
            raise OverflowError(f"SVG exceeds maximum nesting depth ({MAX_DEPTH})")
        self.write(f"<{name}")
        for key, value in zip(attributes[::2], attributes[1::2]):
            lower = key.lower()
            last = lower.rpartition(":")[2]
            if _HANDLER.match(lower) or lower == "xml:base" or (last == "href" and _dangerous(value)):
                continue
            self.out.append(f' {key}="{_escape(css_text(value) if last == "style" else value, True)}"')
        self.open = True
        if local == "style":
            self.style = []

    def end(self, name: str) -> None:
        if self.skipped:
            self.skipped -= 1
            return
        self.depth -= 1
        if self.style:
            self.write(_escape(css_text("".join(self.style))))
        self.style = None
        at = self.parser.CurrentByteIndex
        if self.open and self.data[max(at - 2, 0):at] == b"/>":
            self.out.append("/>")
            self.open = False
        else:
            self.write(f"</{name}>")

    def text(self, text: str) -> None:
        if self.skipped:
            return
        if self.style is not None:
            self.style.append(text)
        else:
            self.write(text if self.cdata else _escape(text))

    def section(self, begins: bool) -> None:
        self.cdata = begins
        if not self.skipped and self.style is None:
            self.write("<![CDATA[" if begins else "]]>")

    def other(self, text: str) -> None:
        # a style sheet from elsewhere would be an import
        if not (self.skipped or self.doctype or self.style is not None or text.startswith("<?xml-stylesheet")):
            self.write(text)


def cleaned(data: bytes | None) -> tuple[str | None, str | None]:
    """The clean text of an image and the kind of error that it has instead, with its message."""
    if data is None:
        return None, None
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        return None, "DecodeFailed: SVG is not valid UTF-8"
    text = text.removeprefix("\ufeff")
    cleaner = _Cleaner(text.encode())
    try:
        cleaner.parser.Parse(text, True)
    except OverflowError as error:
        return None, f"LimitExceeded: {error}"
    except expat.ExpatError as error:
        return None, f"DecodeFailed: SVG parse error: {expat.ErrorString(error.code)}"
    return "".join(cleaner.out), None


@F.pandas_udf(T.StructType([T.StructField("clean", T.StringType()), T.StructField("error", T.StringType())]))
def sanitize(content: pd.Series) -> pd.DataFrame:
    """``(clean, error)`` of each file: without active elements, event handlers, ``xml:base``, dangerous links and style URLs."""
    rows = [cleaned(None if data is None else bytes(data)) for data in content]
    return pd.DataFrame(rows, columns=["clean", "error"], index=content.index, dtype=object)


def straight(colour: Column, alpha: Column) -> Column:
    """A premultiplied colour as it is without its alpha."""
    return F.when(alpha == 0, 0).otherwise(F.least(F.floor((colour * 255 + F.floor(alpha / 2)) / alpha), F.lit(255))).cast("long")
