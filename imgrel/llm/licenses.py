"""Operator 11: licence scans by fuzzy search for short notices.

A text is looked at as its words, lower-cased and joined by single spaces.  A
notice of m characters may differ by one edit (an inserted, deleted or other
character) in so many (``SHARE``) characters, k in all.  It is split into
k + 1 pieces, so k edits leave one of them as it is: every place where a piece
stands exactly (one pass of an automaton over the pieces of all notices) is
grown to the characters that a match around it could cover, what overlaps is
merged, and the regex library's bounded-error matching finds the matches in
these areas and nowhere else.  Of matches that overlap the one with the fewest
edits counts, so that a notice close to another one is not taken for it.

Beside that, the words of a few base phrases are looked up exactly.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table
from .words import word_lists

#: Phrases that are looked up exactly, with their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Short notices of public licences, by label, as words.
NOTICES = (
    ("agpl", "licensed under the gnu affero general public license"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license"),
    ("boost", "distributed under the boost software license version 1 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "released under the bsd license"),
    ("bsd", "licensed under the bsd license"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-nc-nd", "licensed under cc by nc nd 4 0"),
    ("cc-by-nc-sa", "licensed under cc by nc sa 4 0"),
    ("cc-by-nd", "licensed under cc by nd 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc0", "has waived all copyright and related or neighboring rights"),
    ("epl", "made available under the terms of the eclipse public license"),
    ("gpl", "licensed under the gnu general public license version 3"),
    ("gpl", "redistribute it and or modify it under the terms of the gnu general public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee"),
    ("isc", "released under the isc license"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mpl", "subject to the terms of the mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("zlib", "this software is provided as is without any express or implied warranty"),
)
#: One edit is allowed in so many characters of a notice.
SHARE = 12
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


@dataclass(frozen=True)
class Match:
    """A notice found at ``start`` to ``end`` (characters of the joined words), with so many edits."""

    start: int
    end: int
    notice: int
    edits: int


class Notices:
    """Seeds and patterns of a list of ``(label, words)``."""

    def __init__(self, notices: Sequence[tuple[str, str]], share: int = SHARE):
        self.notices, self.errors, self.patterns = notices, [], []
        seeds: dict[str, list[tuple[int, int]]] = {}
        for number, (_, notice) in enumerate(notices):
            errors = len(notice) // share
            self.errors.append(errors)
            self.patterns.append(regex.compile(f"(?e)(?:{regex.escape(notice)}){{e<={errors}}}"))
            cuts = [len(notice) * k // (errors + 1) for k in range(errors + 2)]
            for start, end in zip(cuts, cuts[1:]):
                seeds.setdefault(notice[start:end], []).append((number, start))
        self.automaton = ahocorasick.Automaton()
        for seed, uses in seeds.items():
            self.automaton.add_word(seed, (len(seed), uses))
        self.automaton.make_automaton()

    def areas(self, text: str) -> dict[int, list[tuple[int, int]]]:
        """By notice, the stretches of ``text`` that hold all its matches; they neither overlap nor touch."""
        found: dict[int, list[tuple[int, int]]] = {}
        for last, (length, uses) in self.automaton.iter(text):
            at = last + 1 - length
            for number, offset in uses:
                errors, size = self.errors[number], len(self.notices[number][1])
                found.setdefault(number, []).append((max(0, at - offset - errors), at - offset + size + errors))
        merged = {}
        for number, spans in found.items():
            spans.sort()
            out = [spans[0]]
            for start, end in spans[1:]:
                if start <= out[-1][1]:
                    out[-1] = (out[-1][0], max(end, out[-1][1]))
                else:
                    out.append((start, end))
            merged[number] = out
        return merged

    def matches(self, text: str) -> list[Match]:
        """All matches of each notice that do not overlap matches of the same notice, found from left to right."""
        return [
            Match(*m.span(), number, sum(m.fuzzy_counts))
            for number, spans in self.areas(text).items() for start, end in spans
            for m in self.patterns[number].finditer(text, start, end)
        ]


def disjoint(matches: list[Match]) -> list[Match]:
    """The best of what overlaps: fewest edits first, then the longest, the first in the text, the first notice."""
    starts: list[int] = []
    kept: list[Match] = []
    for m in sorted(matches, key=lambda m: (m.edits, m.start - m.end, m.start, m.notice)):
        at = bisect_left(starts, m.end)
        if not at or kept[at - 1].end <= m.start:
            starts.insert(at, m.start)
            kept.insert(at, m)
    return kept


def phrase_places(text: str, base: Sequence[tuple[str, str]]) -> list[tuple[int, str]]:
    """``(word number, label)`` of each place of a base phrase in the joined words."""
    padded, found = f" {text} ", []
    for phrase, label in base:
        wanted = f" {phrase} "
        at, counted, words = padded.find(wanted), 0, 0
        while at >= 0:
            words += padded.count(" ", counted, at)
            found.append((words, label))
            at, counted = padded.find(wanted, at + 1), at
    return found


def _offsets(text: str, numbers: set[int]) -> dict[int, tuple[int, int]]:
    """Where the words of these numbers stand in the original text, in code points."""
    last = max(numbers, default=-1)
    found = {}
    for number, m in enumerate(_WORD.finditer(text)):
        if number > last:
            break
        if number in numbers:
            found[number] = m.span()
    return found


SPANS = "array<struct<label: string, notice: string, first_word: bigint, last_word: bigint, start: bigint, end: bigint, edits: int>>"
_SCHEMA = (
    "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, "
    f"spans {SPANS}"
)


def look(raw: bytes | None, notices: Notices, base: Sequence[tuple[str, str]] = BASE) -> dict:
    """What ``scan`` reports of one text."""
    raw, parts, n_words = raw or b"", [], 0
    for words in word_lists(raw):
        n_words += len(words)
        parts.append(b" ".join(words))
    text = b" ".join(p for p in parts if p).decode("utf-8", "replace")
    places = phrase_places(text, base)
    spans, score = [], 1.0 if places else 0.0
    matches = disjoint(notices.matches(text))
    if matches:
        counted = words = 0
        for m in matches:
            held = text[m.start : m.end]
            start, end = m.start + len(held) - len(held.lstrip(" ")), m.end - len(held) + len(held.rstrip(" "))
            words += text.count(" ", counted, start)
            counted = start
            label, notice = notices.notices[m.notice]
            score = max(score, 1 - m.edits / len(notice))
            spans.append({"label": label, "notice": notice, "first_word": words, "last_word": words + text.count(" ", start, end), "edits": m.edits})
        where = _offsets(raw.decode("utf-8", "replace"), {s[c] for s in spans for c in ("first_word", "last_word")})
        for s in spans:
            s["start"], s["end"] = where[s["first_word"]][0], where[s["last_word"]][1]
    labels = {label for _, label in places}
    return {
        "n_words": n_words, "n_base": len(places),
        "first_word": min((w for w, _ in places), default=None), "last_word": max((w for w, _ in places), default=None),
        "base_labels": ",".join(sorted(labels)), "labels": ",".join(sorted(labels | {s["label"] for s in spans})),
        "score": score, "spans": spans,
    }


def scan(docs: DataFrame, notices: Sequence[tuple[str, str]] = NOTICES, base: Sequence[tuple[str, str]] = BASE, share: int = SHARE) -> DataFrame:
    """``(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans)``, one row for each row of ``docs``.

    ``spans`` are the notices found: their words' numbers (from 0) and where
    these begin and end in the text, in code points.  ``score`` is 1 for a
    base phrase, else 1 less the share of edited characters of the closest
    notice, else 0.  A null text counts as empty, and an empty one has no
    words, no labels and the score 0.  Repeated rows come back each; other
    columns are ignored; an empty table gives an empty result.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Notices(notices, share)
        for batch in batches:
            found = [look(text.as_py(), known, base) for text in batch.column("text")]
            columns = {name: pa.array([x[name] for x in found], type_) for name, type_ in _TYPES.items()}
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns.values()], ["doc_id", *columns])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, {_SCHEMA}")


_SPAN = pa.struct([
    ("label", pa.string()), ("notice", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()),
    ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32()),
])
_TYPES = {
    "n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(),
    "labels": pa.string(), "score": pa.float64(), "spans": pa.list_(_SPAN),
}


def op11_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
