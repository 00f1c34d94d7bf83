"""Words of a text as bytes: maximal runs of ASCII letters and digits and of all letters beyond ASCII; only A-Z are lower-cased."""

from __future__ import annotations

from collections.abc import Iterator

#: Bytes of a text whose words are looked at together.
PIECE = 1 << 22
_TABLE = bytes(b if b >= 128 or chr(b).isalnum() else 0x20 for b in range(256)).lower()


def spaced(raw: bytes) -> bytes:
    """The text lower-cased, a space for every byte that is part of no word."""
    return raw.translate(_TABLE)


def word_lists(raw: bytes) -> Iterator[list[bytes]]:
    """The words in order, in lists of a bounded size: a longer text is cut at spaces."""
    clean = spaced(raw)
    if len(clean) <= PIECE:
        yield clean.split()
        return
    at = 0
    while at < len(clean):
        end = clean.find(b" ", at + PIECE)
        end = len(clean) if end < 0 else end
        yield clean[at:end].split()
        at = end
