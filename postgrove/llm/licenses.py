"""Fuzzy search for short license notices.

A notice with at most k errors (inserted, deleted or replaced characters) holds at least one of the k + 1
parts that the notice splits into unchanged. All parts of all notices go into one automaton; where a
part occurs, the window around it, as long as the notice and its errors on both sides, is searched with the ``regex`` library's bounded-error
matching, which verifies the edits and gives the span. Of overlapping spans of one notice the one with the fewest errors stays, then the first; what it leaves free of another's window
is searched again. So the work grows with the number of parts that occur, however often they repeat. Beside these, exact phrases ("places") are counted by words.

Texts are compared as words: A-Z in lower case, every other ASCII character that is no digit or letter a gap.
Spans are of words. Defined results: a null text counts as an empty one and has no words; repeated rows
each get their own result; texts of any length are searched whole; an empty table gives an empty one; columns beside doc_id and the text are not read and may have any name.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from postgrove.llm.common import read_table

# Exact phrases with their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Short notices by label, as words.
NOTICES = {
    "apache-2.0": "licensed under the apache license version 2 0",
    "mit": "released under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted",
    "gpl-notice": "licensed under the gnu general public license",
    "lgpl": "licensed under the gnu lesser general public license",
    "mpl-2.0": "subject to the terms of the mozilla public license v 2 0",
    "cc-by-notice": "licensed under a creative commons attribution",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "isc": "permission to use copy modify and or distribute this software for any purpose",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "proprietary": "unauthorized copying of this file via any medium is strictly prohibited",
}
#: One edit for so many characters of a notice, and the most edits: so each exact part keeps ten characters or so.
CHARS_AN_EDIT, MOST_EDITS = 12, 4

_GAPS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str) -> bytes:
    """The words with one space between them, in UTF-8."""
    return b" ".join(text.encode().translate(_GAPS).split())


def places(words: bytes, phrase: str) -> list[int]:
    """The first word of every place where ``phrase`` stands, from 0."""
    padded, needle, out = b" " + words + b" ", b" " + phrase.encode() + b" ", []
    at, seen, upto = padded.find(needle), 0, 0
    while at >= 0:
        seen += padded.count(b" ", upto, at)
        upto = at
        out.append(seen)
        at = padded.find(needle, at + 1)
    return out


def parts(notice: str, errors: int) -> list[tuple[int, str]]:
    """``notice`` in errors + 1 parts of about equal size, each with its offset."""
    cuts = [len(notice) * k // (errors + 1) for k in range(errors + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


class Searcher:
    def __init__(self, notices: dict[str, str], chars_an_edit: int = CHARS_AN_EDIT, most_edits: int = MOST_EDITS):
        import ahocorasick
        import regex

        self.notices = []
        seeds: dict[str, list[tuple[int, int]]] = {}
        for label, notice in notices.items():
            errors = min(most_edits, max(1, len(notice) // chars_an_edit))
            pattern = regex.compile(rf"(?b)(?:{regex.escape(notice, literal_spaces=True)}){{e<={errors}}}")
            for offset, part in parts(notice, errors):
                seeds.setdefault(part, []).append((len(self.notices), offset))
            self.notices.append((label, notice, errors, pattern))
        self.automaton = ahocorasick.Automaton()
        for part, where in seeds.items():
            self.automaton.add_word(part, (len(part), where))
        self.automaton.make_automaton()
        self.best = lru_cache(100_000)(self._best)  # windows are short and repeat from text to text

    def _best(self, k: int, window: str) -> tuple[int, int, int] | None:
        """(errors, start, end) of the best match of notice k in ``window``."""
        _, notice, errors, pattern = self.notices[k]
        m = pattern.search(window) if len(window) >= len(notice) - errors else None
        return (sum(m.fuzzy_counts), m.start(), m.end()) if m else None

    def spans(self, k: int, text: str, windows: set[tuple[int, int]]) -> list[tuple[int, int, int]]:
        """Non-overlapping (start, end, errors) of notice k, of those that its windows hold: the best first, then the first."""
        waiting: list[tuple[int, int, int, int, int]] = []  # errors, start, end, and the window that was searched

        def search(a: int, b: int) -> None:
            found = self.best(k, text[a:b])
            if found:
                heapq.heappush(waiting, (found[0], a + found[1], a + found[2], a, b))

        for a, b in sorted(windows):
            search(a, b)
        taken: list[tuple[int, int, int]] = []  # by start
        while waiting:
            errors, start, end, a, b = heapq.heappop(waiting)
            at = bisect_left(taken, (start, start, 0))
            near = taken[max(0, at - 1) : at + 1]
            if all(end <= x or y <= start for x, y, _ in near):
                taken.insert(at, (start, end, errors))
                continue
            free = a
            for x, y, _ in self._within(taken, a, b):
                if x > free:
                    search(free, x)
                free = max(free, y)
            if free > a and free < b:
                search(free, b)
        return taken

    @staticmethod
    def _within(taken: list[tuple[int, int, int]], a: int, b: int) -> list[tuple[int, int, int]]:
        """The spans that overlap [a, b)."""
        first = max(0, bisect_left(taken, (a, a, 0)) - 1)
        return [t for t in taken[first : bisect_left(taken, (b, b, 0))] if t[1] > a]

    def find(self, text: str) -> list[tuple[int, int, str, float]]:
        """(start, end, label, score) of all notices in ``text``, characters, by start."""
        windows: dict[int, set[tuple[int, int]]] = {}
        for last, (size, where) in self.automaton.iter(text):
            for k, offset in where:
                _, notice, errors, _ = self.notices[k]
                begin = last + 1 - size - offset
                windows.setdefault(k, set()).add((max(0, begin - errors), min(len(text), begin + len(notice) + errors)))
        out = []
        for k, held in windows.items():
            label, notice, _, _ = self.notices[k]
            out += [(a, b, label, 1 - e / len(notice)) for a, b, e in self.spans(k, text, held)]
        return sorted(out)


RESULT = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_fuzzy long, spans array<struct<start:long,end:long,label:string,score:double>>"
_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("score", pa.float64())]))


def scan(docs: DataFrame, text: str = "text", phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES) -> DataFrame:
    """``docs`` (doc_id, text) with word counts, exact places, and the notices found with their spans of words."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Searcher(notices)
        for batch in batches:
            rows = []
            for value in batch.column(1):
                raw = words_of(value.as_py() or "")
                found = {label: places(raw, phrase) for phrase, label in phrases.items()}
                at = [x for held in found.values() for x in held]
                said = raw.decode()
                fuzzy = [(said.count(" ", 0, a + (said[a : a + 1] == " ")), said.count(" ", 0, max(a, b - 1)) + 1, label, score) for a, b, label, score in searcher.find(said)]
                base = {label for label, held in found.items() if held}
                score = max([float(bool(base)), *(s for *_, s in fuzzy)])
                rows.append((raw.count(b" ") + 1 if raw else 0, len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | {f[2] for f in fuzzy})), score, len(fuzzy), [dict(zip(("start", "end", "label", "score"), f)) for f in fuzzy]))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.int64(), _SPAN]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)] if rows else [pa.array([], t) for t in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *(c.split()[0] for c in RESULT.split(", "))])

    return docs.select(F.col("doc_id").cast("long"), text).mapInArrow(search, "doc_id long, " + RESULT)


def op5_license_scan(spark, sf_dir: str) -> DataFrame:
    """Phrases and notices in whole ``documents``."""
    return scan(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
