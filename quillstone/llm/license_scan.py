"""License scan: short notices found with a bounded number of edits.

A notice is a row of words; words in brackets have to stand as they are, every other stretch
may hold one edit (a character put in, left out or replaced) per EACH characters, MOST at the
most. With k edits in all, one of k + 1 disjoint pieces of the notice stands in the text
unharmed (pigeonhole): the pieces of all notices are sought at once by an Aho-Corasick automaton.
Around each seed the window that can hold the notice is matched by the regex library's fuzzy
groups, which check the edits; overlapping windows of one notice are joined first. Nothing that
is within the edits lacks a seed, so the search loses nothing.

Texts are lower-cased (A-Z) and reduced to their words with one space between. Base phrases are
places where the words stand consecutively, counted with repeats and overlaps. Spans are leftmost,
not overlapping per notice, in code points of the text as it is. The score is the best match's share of
characters without an edit (1 for a base phrase, 0 without any match).

Null texts are empty; texts are read whole, of any length, in time in proportion; null ids, ties and
repeated rows come back row by row; an empty table gives none. Other columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: One edit per so many characters of a stretch, and at most so many in one.
EACH, MOST = 7, 4
BASE = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))
#: Label and notice; words in brackets are exact.
NOTICES = (
    ("mit", "under the [mit] license"), ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"), ("mit", "spdx license identifier [mit]"),
    ("apache-2", "apache license version [2]"), ("apache-2", "spdx license identifier [apache 2 0]"),
    ("cc-by-nc", "[cc by nc]"), ("cc-by-nc", "creative commons attribution [noncommercial]"), ("cc-by-nc", "creative commons attribution [non commercial]"),
    ("cc-by-sa", "[cc by sa]"), ("cc-by-sa", "creative commons attribution [sharealike]"), ("cc-by-sa", "creative commons attribution [share alike]"), ("cc-by", "creative commons attribution [4 0]"),
    ("gpl-3", "gnu general public license version [3]"), ("gpl-2", "gnu general public license version [2]"), ("lgpl", "gnu [lesser] general public license"), ("agpl", "gnu [affero] general public license"),
    ("mpl-2", "mozilla public license version [2]"), ("bsd", "under the [bsd] license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"), ("isc", "permission to use copy modify and or distribute this software for any purpose"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)
LOWER = {c: c + 32 for c in range(65, 91)}
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
GAP = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@dataclass(frozen=True)
class Notice:
    """A notice as it is sought: its words with single spaces, the edits of its stretches, and the pattern that checks them."""

    label: str
    text: str
    edits: int
    pattern: str

    @staticmethod
    def of(label: str, words: str) -> Notice:
        text, pattern, edits = "", "", 0
        for part in re.findall(r"\[[^\]]+\]|[^\[]+", words):
            exact = part.startswith("[")
            part = f" {part[1:-1]} " if exact else part.strip(" ")
            k = 0 if exact else min(MOST, len(part) // EACH)
            text, edits = text + part, edits + k
            pattern += f"(?:{regex.escape(part)}){{e<={k}}}" if k else regex.escape(part)
        return Notice(label, text, edits, pattern)

    def pieces(self) -> list[tuple[int, str]]:
        """One more piece than edits, with its place in the notice."""
        n = self.edits + 1
        cut = [len(self.text) * i // n for i in range(n + 1)]
        return [(a, self.text[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]


class Scanner:
    def __init__(self, notices: tuple, base: tuple):
        self.base = [(label, f" {phrase} ") for label, phrase in base]
        self.notices = [Notice.of(*x) for x in notices]
        self.patterns = [regex.compile("(?e)" + n.pattern) for n in self.notices]
        seeds: dict[str, list[tuple[int, int]]] = {}
        for i, n in enumerate(self.notices):
            for at, piece in n.pieces():
                seeds.setdefault(piece, []).append((i, at))
        self.seeds = ahocorasick.Automaton()
        for piece, places in seeds.items():
            self.seeds.add_word(piece, (len(piece), places))
        if seeds:
            self.seeds.make_automaton()

    def windows(self, norm: str) -> dict[int, list[list[int]]]:
        """Per notice the joined windows around its seeds, in order."""
        out: dict[int, list[list[int]]] = {}
        for last, (n, places) in self.seeds.iter(norm) if self.notices else ():
            for i, at in places:
                notice = self.notices[i]
                start = last + 1 - n - at
                a, b = max(0, start - notice.edits), min(len(norm), start + len(notice.text) + notice.edits)
                held = out.setdefault(i, [])
                # Seeds end in order but windows may start out of it, by less than a notice.
                while held and held[-1][1] >= a:
                    before = held.pop()
                    a, b = min(a, before[0]), max(b, before[1])
                held.append([a, b])
        return out

    def matches(self, norm: str) -> list[tuple[int, int, int, int]]:
        """(start, end, notice, edits) in the reduced text."""
        return [
            (m.start(), m.end(), i, sum(m.fuzzy_counts))
            for i, windows in self.windows(norm).items() for a, b in windows for m in self.patterns[i].finditer(norm, a, b)
        ]

    def scan(self, text: str | None) -> dict:
        low = (text or "").translate(LOWER)
        norm = GAP.sub(" ", low).strip(" ")
        norm = f" {norm} " if norm else ""
        places: list[int] = []
        base: set[str] = set()
        for label, phrase in self.base:
            at = norm.find(phrase)
            while at >= 0:
                places.append(norm.count(" ", 0, at))
                base.add(label)
                at = norm.find(phrase, at + 1)
        found = self.matches(norm)
        labels = base | {self.notices[i].label for _, _, i, _ in found}
        score = 1.0 if base else max((1 - e / len(self.notices[i].text) for _, _, i, e in found), default=0.0)
        return {
            "n_words": max(0, norm.count(" ") - 1), "n_base": len(places), "first_word": min(places, default=None), "last_word": max(places, default=None),
            "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(labels)), "score": score, "spans": self.spans(low, norm, found) if found else [],
        }

    def spans(self, low: str, norm: str, found: list[tuple[int, int, int, int]]) -> list[dict]:
        """Matches as spans of the text: words of both texts stand in the same order."""
        inside, outside = [m.start() for m in WORD.finditer(norm)], [m.span() for m in WORD.finditer(low)]

        def place(at: int) -> int:
            w = max(0, bisect_right(inside, at) - 1)
            return min(outside[w][0] + max(0, at - inside[w]), outside[w][1])

        out = []
        for a, b, i, edits in sorted(found):
            while a < b and norm[a] == " ":
                a += 1
            while b > a and norm[b - 1] == " ":
                b -= 1
            if a < b:
                out.append({"label": self.notices[i].label, "start": place(a), "end": place(b - 1) + 1, "edits": edits})
        return out


@lru_cache(4)
def scanner(notices: tuple, base: tuple) -> Scanner:
    return Scanner(notices, base)


RESULT = pa.struct([
    ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
    ("spans", pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int64())]))),
])
SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label string, start long, end long, edits long>>"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices: tuple = NOTICES, base: tuple = BASE) -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = scanner(notices, base)
        for batch in batches:
            rows = pa.array([held.scan(t.as_py()) for t in batch.column(1)], RESULT)
            yield pa.RecordBatch.from_arrays([batch.column(0), *rows.flatten()], [id_col, *RESULT.names])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, {SCHEMA}")
