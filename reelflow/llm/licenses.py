"""License notices in texts: exact phrases, and known short notices with a few edits.

A notice of n characters may differ in k = n / ``PER_EDIT`` edits. Cut into k + 1 pieces, one piece must
occur unchanged; one Aho-Corasick automaton finds all pieces of all notices, and around its hits Myers'
bit-parallel edit distance finds all ends of matches. Of matches of a notice that overlap, the one with the
fewest edits is chosen, then the one that ends first, then the shortest; what it leaves free to its left
and right is searched on. A match counts only if the words that tell its license from others stand in it
unchanged and in order: the edits allowed are for the rest. A match that lies within another one with no more
edits, of another license, gives way to it ("cc by" within "cc by sa").

Texts are compared as normalised words (A-Z lower-cased, other ASCII separators dropped) joined by a
space. A null text has no words. Each row is judged alone: repeats and ties need no rule. Candidates are
windows of a notice's length, so a long text costs in proportion to its length and hits. An empty list of
notices leaves the phrases, an empty table gives an empty result; columns other than doc_id and text are not returned.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelflow.llm.common import text_slices
from reelflow.llm.decontaminate import words_of

#: Phrases and their labels. Fixed values.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: Short notices as licenses and their users word them, normalised: label, words that must stand in the match as they
#: are (they tell the license from others; the notice's edits are for the rest), notice.
NOTICES: tuple[tuple[str, str, str], ...] = (
    ("apache", "apache", "licensed under the apache license version 2 0"),
    ("apache", "apache", "released under the apache license version 2 0"),
    ("apache", "apache", "distributed under the apache license"),
    ("apache", "compliance license", "you may not use this file except in compliance with the license"),
    ("mit", "mit", "released under the mit license"),
    ("mit", "mit", "licensed under the mit license"),
    ("mit", "mit", "distributed under the mit license"),
    ("mit", "mit", "the mit license mit"),
    ("mit", "permission granted", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", "copyright notice", "the above copyright notice and this permission notice shall be included in all copies"),
    ("gpl", "free software", "this program is free software you can redistribute it and or modify it"),
    ("gpl", "gnu general", "under the terms of the gnu general public license"),
    ("gpl", "gnu general", "licensed under the gnu general public license version"),
    ("gpl", "gnu general", "you should have received a copy of the gnu general public license"),
    ("gpl", "gpl", "licensed under the gpl license"),
    ("gpl", "gpl", "released under the gpl license"),
    ("gpl-2", "gplv2", "licensed under the gplv2"),
    ("gpl-3", "gplv3", "licensed under the gplv3"),
    ("lgpl", "lesser", "gnu lesser general public license"),
    ("lgpl", "library", "gnu library general public license"),
    ("lgpl", "lgpl", "licensed under the lgpl license"),
    ("agpl", "affero", "gnu affero general public license"),
    ("agpl", "agpl", "licensed under the agpl license"),
    ("fdl", "documentation", "gnu free documentation license"),
    ("bsd", "bsd", "released under the bsd license"),
    ("bsd", "bsd", "licensed under the bsd license"),
    ("bsd", "bsd", "use of this source code is governed by a bsd style license"),
    ("bsd", "source binary", "redistribution and use in source and binary forms with or without modification"),
    ("bsd-2", "bsd 2", "licensed under the bsd 2 clause license"),
    ("bsd-3", "bsd 3", "licensed under the bsd 3 clause license"),
    ("mpl", "mozilla", "this source code form is subject to the terms of the mozilla public license"),
    ("mpl", "mozilla", "licensed under the mozilla public license"),
    ("mpl", "mpl", "released under the mpl license"),
    ("epl", "eclipse", "licensed under the eclipse public license"),
    ("epl", "eclipse", "made available under the terms of the eclipse public license"),
    ("eupl", "european union", "licensed under the european union public licence"),
    ("cddl", "development distribution", "common development and distribution license"),
    ("artistic", "artistic", "licensed under the artistic license"),
    ("isc", "copy modify", "permission to use copy modify and or distribute this software for any purpose"),
    ("isc", "isc", "licensed under the isc license"),
    ("zlib", "zlib", "licensed under the zlib license"),
    ("zlib", "express implied", "this software is provided as is without any express or implied warranty"),
    ("boost", "boost", "distributed under the boost software license"),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("public-domain", "public domain", "this work is in the public domain"),
    ("public-domain", "public domain", "has been released into the public domain"),
    ("cc0", "cc0", "licensed under cc0 1 0 universal"),
    ("cc0", "dedicated public domain", "has dedicated the work to the public domain"),
    ("wtfpl", "fuck", "do what the fuck you want to public license"),
    ("cc-by", "by", "licensed under cc by 4 0"),
    ("cc-by", "attribution 4", "creative commons attribution 4 0 international"),
    ("cc-by", "attribution", "licensed under a creative commons attribution license"),
    ("cc-by-sa", "by sa", "licensed under cc by sa 4 0"),
    ("cc-by-sa", "share alike", "creative commons attribution share alike"),
    ("cc-by-sa", "sharealike", "creative commons attribution sharealike"),
    ("cc-by-nc", "by nc 4", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "noncommercial", "creative commons attribution noncommercial"),
    ("cc-by-nd", "by nd", "licensed under cc by nd 4 0"),
    ("cc-by-nd", "noderivatives", "creative commons attribution noderivatives"),
    ("cc-by-nc-sa", "by nc sa", "licensed under cc by nc sa 4 0"),
    ("cc-by-nc-nd", "by nc nd", "licensed under cc by nc nd 4 0"),
    ("ofl", "open font", "licensed under the sil open font license"),
    ("odbl", "database", "made available under the open database license"),
    ("proprietary", "reserved reproduced", "all rights reserved no part of this publication may be reproduced"),
    ("proprietary", "proprietary confidential", "this file is proprietary and confidential"),
    ("proprietary", "unauthorized copying", "unauthorized copying of this file via any medium is strictly prohibited"),
)
PER_EDIT = 10


def edits_of(notice: str) -> int:
    return max(1, len(notice) // PER_EDIT)


def pieces_of(notice: str, edits: int) -> list[tuple[int, str]]:
    """The notice cut into edits + 1 pieces of nearly equal length: (offset, piece)."""
    cuts = [len(notice) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


@functools.lru_cache(maxsize=4)
def searcher(notices: tuple[tuple[str, str, str], ...] = NOTICES):
    """(automaton of pieces to (notice, offset), finder per notice, pattern of its exact words)."""
    seeds: dict[str, list[tuple[int, int]]] = {}
    for i, (_, _, notice) in enumerate(notices):
        for offset, piece in pieces_of(notice, edits_of(notice)):
            seeds.setdefault(piece, []).append((i, offset))
    automaton = ahocorasick.Automaton()
    for piece, owners in seeds.items():
        automaton.add_word(piece, (len(piece), owners))
    automaton.make_automaton()
    exact = [re.compile(".*?".join(rf"(?<!\S){re.escape(w)}(?!\S)" for w in words.split()), re.DOTALL) for _, words, _ in notices]
    return automaton, [Finder(notice, edits_of(notice)) for _, _, notice in notices], exact


def _masks(notice: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for j, c in enumerate(notice):
        out[c] = out.get(c, 0) | 1 << j
    return out


class Finder:
    """Matches of one notice with at most ``k`` edits."""

    def __init__(self, notice: str, k: int) -> None:
        self.n, self.k = len(notice), k
        self.forward, self.backward = _masks(notice), _masks(notice[::-1])

    def ends(self, text: str, p: int, q: int, most: int, first: bool = False) -> list[tuple[int, int]]:
        """(edits, end) of each end in text[p:q] with at most ``most`` edits from its best start, or only of the first."""
        full, top = (1 << self.n) - 1, 1 << self.n - 1
        get = self.forward.get
        up, down, d = full, 0, self.n
        out = []
        for e, c in enumerate(text[p:q], p + 1):
            eq = get(c, 0)
            x = eq | down
            same = (((eq & up) + up) ^ up) | eq
            plus = down | ~(same | up)
            minus = up & same
            if plus & top:
                d += 1
            elif minus & top:
                d -= 1
            plus <<= 1
            up = (minus << 1 | ~(x | plus)) & full
            down = plus & x & full
            if d <= most:
                out.append((d, e))
                if first:
                    break
        return out

    def start(self, text: str, p: int, end: int, edits: int) -> int:
        """The last start from ``p`` on of a match that ends at ``end`` with so many edits."""
        full, top = (1 << self.n) - 1, 1 << self.n - 1
        get = self.backward.get
        up, down, d = full, 0, self.n
        for s in range(end - 1, p - 1, -1):
            eq = get(text[s], 0)
            x = eq | down
            same = (((eq & up) + up) ^ up) | eq
            plus = down | ~(same | up)
            minus = up & same
            if plus & top:
                d += 1
            elif minus & top:
                d -= 1
            plus = plus << 1 | 1
            up = (minus << 1 | ~(x | plus)) & full
            down = plus & x & full
            if d == edits:
                return s
        raise ValueError("no match ends here")

    def spans(self, text: str, p: int, q: int) -> list[tuple[int, int, int]]:
        """(start, end, edits) of disjoint matches in text[p:q], in order."""
        out: list[tuple[int, int, int]] = []
        far = self.n + self.k
        todo = [(p, q)]
        while todo:
            p, q = todo.pop()
            hit = self.ends(text, p, q, self.k, first=True)
            if not hit:
                continue
            d, e = hit[0]
            s, before = self.start(text, p, e, d), e
            while True:  # to a better one that overlaps, until there is none
                better = sorted(x for x in self.ends(text, max(p, s - far), min(q, e + far), d) if x < (d, e) and x[1] > s)
                spans = ((self.start(text, p, y, x), y, x) for x, y in better)
                found = next((x for x in spans if x[0] < e), None)
                if not found:
                    break
                s, e, d = found
            out.append((s, e, d))
            todo.append((e, q))
            if s >= before:
                todo.append((max(p, before - far), s))
        return sorted(out)


def fuzzy_notices(text: str, notices: tuple[tuple[str, str, str], ...] = NOTICES) -> list[tuple[int, int, int, int]]:
    """(notice, start, end, edits) of notices in a normalised text, by notice and start; those of a notice never overlap."""
    if not notices:
        return []
    automaton, finders, exact = searcher(notices)
    windows: dict[int, list[tuple[int, int]]] = {}
    for end, (size, owners) in automaton.iter(text):
        for i, offset in owners:
            at, k, n = end + 1 - size - offset, finders[i].k, finders[i].n
            windows.setdefault(i, []).append((max(0, at - k), min(len(text), at + n + k)))
    found = []
    for i in sorted(windows):
        merged: list[list[int]] = []
        for a, b in sorted(windows[i]):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        for a, b in merged:
            found += [(i, *x) for x in finders[i].spans(text, a, b) if exact[i].search(text, _word_start(text, x[0]), _word_end(text, x[1]))]
    return _nearest(found, notices)


def _word_start(text: str, at: int) -> int:
    """Where the word that ``at`` cuts begins."""
    return text.rfind(" ", 0, at + 1) + 1


def _word_end(text: str, at: int) -> int:
    end = text.find(" ", at - 1)
    return len(text) if end < 0 else end


def _nearest(found: list[tuple[int, int, int, int]], notices: tuple[tuple[str, str, str], ...]) -> list[tuple[int, int, int, int]]:
    """Without matches that overlap one of another license that is nearer: fewer edits, then longer."""
    rank = lambda x: (x[3], x[1] - x[2], x[0])
    by_start = sorted(found, key=lambda x: (x[1], x[2]))
    beaten: set[tuple[int, int, int, int]] = set()
    live: list[tuple[int, int, int, int]] = []
    for x in by_start:
        live = [y for y in live if y[2] > x[1]]
        for y in live:
            if notices[x[0]][0] != notices[y[0]][0]:
                beaten.add(max(x, y, key=rank))
        live.append(x)
    return [x for x in found if x not in beaten]


def phrase_starts(words: list[bytes], text: bytes) -> list[tuple[int, str]]:
    """(word position, label) of every place of every phrase. ``text``: the words joined, a space at both ends."""
    out = []
    for phrase, label in PHRASES:
        needle = b" " + phrase.encode() + b" "
        at, seen, word = text.find(needle), 0, 0
        while at >= 0:
            word += text.count(b" ", seen, at)
            seen = at
            out.append((word, label))
            at = text.find(needle, at + 1)
    return out


def find_licenses(docs: DataFrame, notices: tuple[tuple[str, str, str], ...] = NOTICES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, notices) per row.

    ``notices``: label:first word:last word:edits of each fuzzy match, comma-joined. ``score``: 1 for a
    phrase, else the best share of a notice's characters that needed no edit, 0 without any.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_slices(batches):
            out: list[list] = [[] for _ in range(8)]
            for raw in texts:
                words = words_of(raw)
                joined = b" ".join(words)
                base = phrase_starts(words, b" " + joined + b" ")
                text = joined.decode("latin-1")
                fuzzy = fuzzy_notices(text, notices)
                starts, labels = [w for w, _ in base], {x for _, x in base}
                every = labels | {notices[i][0] for i, *_ in fuzzy}
                best = 1.0 if base else max((1 - e / len(notices[i][2]) for i, _, _, e in fuzzy), default=0.0)
                where = ",".join(f"{notices[i][0]}:{text.count(' ', 0, a)}:{text.count(' ', 0, b)}:{e}" for i, a, b, e in fuzzy)
                row = (len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)), ",".join(sorted(every)), best, where)
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays([rows.column(0), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "notices"])

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, notices string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
