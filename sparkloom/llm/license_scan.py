"""License scans: exact phrases, and short notices with a bounded number of edits.

A notice of n letters may differ by ``edits`` insertions, deletions or substitutions. By the pigeonhole
principle, a text within e edits of it holds at least one of e+1 pieces of it unchanged, so those pieces are
searched first, by one automaton; only around their hits does the regex library's bounded-error matching
run, and it reports the span and the number of edits. A match begins and ends with a word.

Null and empty texts have no words, no labels and score 0; texts are read whole; repeated rows are scanned
alike; a key that is no number becomes null; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import ahocorasick
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import map_columns

#: Every ASCII byte that is no letter or digit separates words; A-Z are lowered, other bytes stay.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

#: Label -> phrase whose words must stand consecutively.
PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}

#: Short notices that are found with edits as well: (label, notice).
NOTICES = [
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "creative commons attribution noncommercial"),
    ("cc-by-sa", "creative commons attribution sharealike"),
    ("cc-by", "creative commons attribution 4 0 international"),
    ("cc0", "dedicated to the public domain"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("gpl", "the terms of the gnu general public license"),
    ("lgpl", "gnu lesser general public license"),
    ("agpl", "gnu affero general public license"),
    ("mpl-2", "mozilla public license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms"),
    ("epl-2", "eclipse public license version 2 0"),
    ("isc", "permission to use copy modify and or distribute this software"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("proprietary", "all rights reserved"),
    ("apache-2", "http www apache org licenses license 2 0"),
    ("mit", "the software is provided as is without warranty of any kind express or implied"),
    ("isc", "the software is provided as is and the author disclaims all warranties"),
    ("zlib", "this software is provided as is without any express or implied warranty"),
    ("bsd", "this software is provided by the copyright holders and contributors as is"),
    ("bsd-3", "neither the name of the copyright holder nor the names of its contributors"),
    ("gpl-2", "licensed under the gnu general public license version 2"),
    ("gpl-2", "either version 2 of the license or at your option any later version"),
    ("gpl-3", "either version 3 of the license or at your option any later version"),
    ("gfdl", "gnu free documentation license"),
    ("cddl", "common development and distribution license"),
    ("eupl", "european union public licence"),
    ("artistic-2", "the artistic license 2 0"),
    ("bsl-1", "boost software license version 1 0"),
    ("ofl-1.1", "sil open font license version 1 1"),
    ("ms-pl", "microsoft public license"),
    ("python-2", "python software foundation license version 2"),
    ("odbl", "open data commons open database license"),
    ("pddl", "open data commons public domain dedication and license"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-nd", "creative commons attribution noderivatives"),
    ("cc-by-nc-sa", "creative commons attribution noncommercial sharealike"),
    ("cc-by-nc-nd", "creative commons attribution noncommercial noderivatives"),
]


def edits_of(notice: str) -> int:
    """One edit for every 12 letters, from 1 to 4."""
    return max(1, min(4, len(notice) // 12))


def pieces(notice: str, edits: int) -> list[tuple[int, str]]:
    """edits + 1 adjacent pieces, as even as can be: (offset, piece)."""
    cuts = [len(notice) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


#: Lengths of a notice that are searched for its best match at a time.
TOGETHER = 8


def best_matches(pattern: regex.Pattern, text: str, low: int, high: int, reach: int) -> Iterator[regex.Match]:
    """Matches, none longer than reach, between low and high: the best of a stretch comes first, others may stand before and
    after it. Matches that come near the end of a stretch are left to the next one, which begins before them."""
    while low < high:
        end = min(high, low + TOGETHER * reach)
        rest, found = [(low, end)], []
        while rest:
            a, b = rest.pop()
            if m := pattern.search(text, a, b):
                found.append(m)
                rest += [(a, m.start()), (m.end(), b)]
        if end == high:
            yield from found
            return
        found = [m for m in found if m.end() <= end - reach]
        yield from found
        low = max((m.end() for m in found), default=low)
        low = max(low, end - 2 * reach)


class Scanner:
    """Finds phrases and notices in one text."""

    def __init__(self, phrases: Mapping[str, str] = PHRASES, notices: list[tuple[str, str]] = NOTICES, edits: Callable[[str], int] = edits_of) -> None:
        self.phrases = [(label, b" " + phrase.encode() + b" ") for label, phrase in phrases.items()]
        self.notices = [(label, text, edits(text), regex.compile(rf"(?be)(?<![^ ])(?:{regex.escape(text)}){{e<={edits(text)}}}(?![^ ])")) for label, text in notices]
        seeds: dict[str, list[tuple[int, int]]] = {}
        for k, (_, text, e, _) in enumerate(self.notices):
            for at, piece in pieces(text, e):
                seeds.setdefault(piece, []).append((k, at))
        self.machine = ahocorasick.Automaton()
        for piece, where in seeds.items():
            self.machine.add_word(piece, (len(piece), where))
        self.machine.make_automaton()

    def normal(self, text: str | None) -> bytes:
        return b" ".join((text or "").encode("utf-8", "replace").translate(_WORD_BYTES).split())

    def exact(self, words: bytes) -> list[tuple[str, int]]:
        """(label, first word) of every place."""
        padded, out = b" " + words + b" ", []
        for label, phrase in self.phrases:
            at = padded.find(phrase)
            while at >= 0:
                out.append((label, at))
                at = padded.find(phrase, at + 1)
        out.sort(key=lambda x: x[1])
        found, seen, upto = [], 0, 0
        for label, at in out:
            seen += padded.count(b" ", upto, at)
            upto = at
            found.append((label, seen))
        return found

    def fuzzy(self, words: bytes) -> list[tuple[str, int, int, int, float]]:
        """(label, start, end, edits, similarity) of the notices, in letters of the words joined by blanks."""
        text = words.decode("utf-8", "replace")
        spans: dict[int, list[list[int]]] = {}
        for last, (n, where) in self.machine.iter(text):
            for k, at in where:
                _, notice, e, _ = self.notices[k]
                start = last + 1 - n - at
                # an area ends with a word, where a match may end
                low, high = max(0, text.rfind(" ", 0, max(0, start - e)) + 1), text.find(" ", min(len(text), start + len(notice) + e))
                high = len(text) if high < 0 else high
                mine = spans.setdefault(k, [])
                if mine and low <= mine[-1][1]:
                    mine[-1][0], mine[-1][1] = min(low, mine[-1][0]), max(high, mine[-1][1])
                else:
                    mine.append([low, high])
        out = []
        for k, areas in spans.items():
            label, notice, _, pattern = self.notices[k]
            for low, high in areas:
                for m in best_matches(pattern, text, low, high, len(notice) + self.notices[k][2]):
                    e = sum(m.fuzzy_counts)
                    out.append((label, m.start(), m.end(), e, 1.0 - e / len(notice)))
        # where notices overlap by more than half, the one with the fewest edits explains the place; only spans that begin
        # within the longest span's length can overlap
        wide = max((x[2] - x[1] for x in out), default=0) + 1
        kept: dict[int, list[tuple[str, int, int, int, float]]] = {}
        for x in sorted(out, key=lambda x: (x[3], x[1], -x[2], x[0])):
            near = (y for i in range(x[1] // wide - 1, x[2] // wide + 1) for y in kept.get(i, ()))
            if not any(y[3] < x[3] and y[0] != x[0] and 2 * (min(x[2], y[2]) - max(x[1], y[1])) > x[2] - x[1] for y in near):
                kept.setdefault(x[1] // wide, []).append(x)
        return sorted(x for some in kept.values() for x in some)

    def scan(self, text: str | None) -> tuple:
        words = self.normal(text)
        base = self.exact(words)
        near = self.fuzzy(words)
        base_labels = sorted({label for label, _ in base})
        labels = sorted({*base_labels, *(x[0] for x in near)})
        score = 1.0 if base else max((x[4] for x in near), default=0.0)
        return (
            words.count(b" ") + 1 if words else 0,
            len(base),
            base[0][1] if base else None,
            base[-1][1] if base else None,
            ",".join(base_labels),
            ",".join(labels),
            score,
            [{"label": a, "start": b, "end": c, "edits": e, "similarity": s} for a, b, c, e, s in near],
        )


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,start:long,end:long,edits:long,similarity:double>>"


def scan_licenses(df: DataFrame, phrases: Mapping[str, str] = PHRASES, notices: list[tuple[str, str]] = NOTICES, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row a document: counts, labels, score and the spans of the notices found."""

    def make() -> Callable[..., Iterator[tuple]]:
        scanner = Scanner(phrases, notices)
        return lambda keys, texts: ((k, *scanner.scan(t)) for k, t in zip(keys, texts, strict=True))

    return map_columns(df, [F.col(key).try_cast("long"), F.col(text)], SCHEMA, make)
