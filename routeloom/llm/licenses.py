"""License scans by conditional compression.

Candidate blocks are the stretches of a text's words in which some notice may lie: a notice with at most k edits keeps one of its k + 1 pieces, so looking up
the pieces of all notices misses none.  Blocks are windows of the whole text, so line breaks and comment marks within a notice do not matter.

Each block is compressed alone and with each license's template, its notices, as a zstandard raw-content dictionary.  Licenses are tried by the bytes that
their template saves, most first.  The first that exact wording confirms is the block's: its notices stand there with at most `tolerance` of their words missing
or put in between, none of them a name or number by which licenses differ, no negation before and no other version after them, and agree with well over half as many
words as those of any license do; where words differ, with the most.  They are taken, and the words that are left on both sides are blocks again, so one text may declare several licenses; `X or Y` and `X and Y` give both.

Defined results: null and empty texts give no rows; a text may hold several notices, each a row; repeated
rows repeat their findings; a null id is kept; of equal savings the first name is tried first; an empty table gives no rows.  Only the named columns are read.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import license_forms
from .shingles import row_slices

#: The notices by which well-known licenses are declared.
NOTICES: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
    ),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.",),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3.",),
    "AGPL-3.0": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "Notwithstanding any other provision of this License, if you modify the Program, your modified version must prominently offer all users interacting with it remotely through a computer network (if your version supports such interaction) an opportunity to receive the Corresponding Source of your version",
    ),
    "BSD-3-Clause": (
        "Released under the BSD 3-Clause License.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "BSD-2-Clause": (
        "Released under the BSD 2-Clause License.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS",
    ),
    "BSD-4-Clause": ("All advertising materials mentioning features or use of this software must display the following acknowledgement",),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "Released under the ISC License."),
    "CC-BY-4.0": ("This work is licensed under a Creative Commons Attribution 4.0 International License.",),
    "CC-BY-SA-4.0": ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",),
    "CC0-1.0": ("This work has been dedicated to the public domain under CC0 1.0 Universal.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "Public-Domain": ("This work is in the public domain.", "released into the public domain", "placed in the public domain", "dedicated to the public domain"),
    "All-Rights-Reserved": ("All rights reserved.",),
}
WORD = re.compile(r"[0-9a-z]+")
#: The share of the most words that any license's notices agree with in a block, which the winner's have to reach.
AGREEING = 0.6
#: Within so many words of a notice, names of licenses are references.
NEARBY = 60
#: Comment marks made of letters; other marks are no words anyway.
MARK = re.compile(r"(?m)^[^0-9a-z\n]*(?:rem|dnl)\b")
FOUND = "doc_id long, line long, license string, reduction double, plain_bytes long, with_template_bytes long, missing string, inserted string"


def words(text: str) -> list[str]:
    return WORD.findall(MARK.sub("", text.lower().replace("licence", "license")))


@cache
def templates() -> dict[str, list[list[str]]]:
    """The notices of each license with the usual short forms and the paragraphs of whole texts, as words."""
    return license_forms.templates(NOTICES, words)


@cache
def scanner(tolerance: float) -> Scanner:
    """Built once in a worker."""
    return Scanner(tolerance=tolerance)


def extend(pattern: list[str], text: list[str], limit: int) -> tuple[int, list[str], list[str]] | None:
    """The least edits, up to `limit`, by which all of `pattern` starts `text`: words of the text used, words missing, words put in between."""
    steps: list[dict[int, tuple[int, int]]] = []  # after d edits, by diagonal (text less pattern words): pattern words done, last move
    for d in range(limit + 1):
        steps.append({})
        for g in range(-d, d + 1, 2):
            before = [(steps[d - 1][h][0] + (h > g), g - h) for h in (g + 1, g - 1) if h in steps[d - 1]] if d else [(0, 0)]
            y, move = max((o for o in before if o[0] + g <= len(text)), default=(-1, 0))
            while 0 <= y < len(pattern) and y + g < len(text) and pattern[y] == text[y + g]:
                y += 1
            if y >= 0:
                steps[d][g] = y, move
            if y == len(pattern):
                used, missing, inserted = y + g, [], []
                for e in range(d, 0, -1):
                    move = steps[e][g][1]
                    g -= move
                    done = steps[e - 1][g][0]
                    (missing if move < 0 else inserted).append(pattern[done] if move < 0 else text[done + g])
                return used, missing[::-1], inserted[::-1]
    return None


class Match(NamedTuple):
    start: int
    end: int
    name: str
    kept: int
    missing: tuple[str, ...]
    inserted: tuple[str, ...]


class Piece(NamedTuple):
    start: int
    end: int
    name: str
    notice: list[str]


class Found(NamedTuple):
    start: int
    license: str
    reduction: float
    plain_bytes: int
    with_template_bytes: int
    missing: str
    inserted: str


class Scanner:
    """Templates as dictionaries, and their notices by piece."""

    def __init__(self, level: int = 9, tolerance: float = 0.1) -> None:
        self.level, self.tolerance = level, tolerance
        self.plain = zstandard.ZstdCompressor(level=level, write_content_size=False)
        self.coders: dict[str, zstandard.ZstdCompressor] = {}
        self.pieces: dict[tuple[str, ...], dict[tuple[int, int], dict[tuple[str, ...], list[Piece]]]] = {}  # by two words, their place and the length, all words
        for name, notices in templates().items():
            dictionary = zstandard.ZstdCompressionDict(" ".join(w for n in notices for w in n).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            dictionary.precompute_compress(level=level)
            self.coders[name] = zstandard.ZstdCompressor(dict_data=dictionary, write_content_size=False, write_dict_id=False)
            for notice in notices:
                count = min(int(tolerance * len(notice)) + 1, len(notice))
                cuts = [len(notice) * k // count for k in range(count + 1)]
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    key = max(range(a, max(a + 1, b - 1)), key=lambda k, n=notice: sum(map(len, n[k : k + 2])))  # long words are rare
                    alike = self.pieces.setdefault(tuple(notice[key : min(key + 2, b)]), {}).setdefault((key - a, b - a), {})
                    alike.setdefault(tuple(notice[a:b]), []).append(Piece(a, b, name, notice))
        self.single = any(len(k) == 1 for k in self.pieces)

    def hits(self, text: list[str]) -> Iterator[tuple[int, int, Piece]]:
        """Every piece that stands in the text, with its place."""
        places = [(i, k) for i, k in enumerate(zip(text, text[1:], strict=False)) if k in self.pieces]
        if self.single:
            places += [(i, (w,)) for i, w in enumerate(text) if (w,) in self.pieces]
        starts = ((i - place, i - place + n, alike) for i, key in places for (place, n), alike in self.pieces[key].items() if i >= place)
        return ((at, end, p) for at, end, alike in starts for p in alike.get(tuple(text[at:end]), ()))

    def blocks(self, text: list[str]) -> list[tuple[int, int, list[tuple[int, int, Piece]]]]:
        """(start, end, hits) of the stretches in which a notice may lie: where the notices of the pieces that stand there would reach, as far as these overlap."""
        spans = [(max(0, at - p.start), min(len(text), end + len(p.notice) - p.end), (at, end, p)) for at, end, p in self.hits(text)]
        out: list[tuple[int, int, list[tuple[int, int, Piece]]]] = []
        for start, end, hit in sorted(spans, key=lambda s: s[:2]):
            if out and start < out[-1][1]:
                out[-1][2].append(hit)
                out[-1] = (out[-1][0], max(end, out[-1][1]), out[-1][2])
            else:
                out.append((start, end, [hit]))
        return out

    def sizes(self, block: list[str]) -> tuple[int, dict[str, int]]:
        """Bytes of the block compressed alone, and with each license's template."""
        text = " ".join(block).encode()
        return len(self.plain.compress(text)), {name: len(coder.compress(text)) for name, coder in self.coders.items()}

    def confirmed(self, text: list[str], at: int, end: int, p: Piece) -> Match | None:
        """The notice around a piece, if its wording agrees."""
        limit = int(self.tolerance * len(p.notice))
        left = extend(p.notice[: p.start][::-1], text[max(0, at - p.start - limit) : at][::-1], limit)
        rest = p.notice[p.end :]
        right = left and extend(rest, text[end : end + len(rest) + limit], limit - len(left[1]) - len(left[2]))
        if not right:
            return None
        missing, inserted = (left[k][::-1] + right[k] for k in (1, 2))
        start, stop = at - left[0], end + right[0]
        if license_forms.other_license(p.notice, missing, inserted) or license_forms.refused(p.notice, start, stop, text):
            return None
        return Match(start, stop, p.name, len(p.notice) - len(missing), tuple(missing), tuple(inserted))

    def scan(self, text: list[str]) -> list[Found]:
        """The notices of a text in order."""
        blocks, joined, notes = [], set(), []
        for start, end, hits in self.blocks(text):
            own: dict[str, set[Match]] = {}
            for at, stop, p in hits:
                if m := self.confirmed(text, at, stop, p):
                    joined.add(m) if p.notice[0] in license_forms.JOINED else own.setdefault(p.name, set()).add(m)
            notes += {(m.start, m.end) for group in own.values() for m in group if m.kept >= license_forms.NOTE}
            blocks.append((start, end, own))
        taken: list[Match] = []
        for start, end, own in blocks:
            if any(a < end + NEARBY and start < b + NEARBY for a, b in notes):  # a license text names others without declaring them
                own = {name: {m for m in group if tuple(text[m.start : m.end]) not in license_forms.titles()} for name, group in own.items()}
            taken += self._taken(text, start, end, own, 0, len(text))
        while more := [m for m in joined if any(m.start == t.end for t in taken) and not any(m.start < t.end and t.start < m.end for t in taken)]:
            widest = max(more, key=lambda m: (m.end - m.start, -m.start))  # the longest wording of what is joined
            same = [m for m in more if (m.start, m.end) == (widest.start, widest.end)]
            taken += self._taken(text, widest.start, widest.end, {m.name: {m} for m in same}, widest.start, widest.end)
        found = []
        for m in taken:
            plain, sizes = self.sizes(text[m.start : m.end])
            found.append(Found(m.start, m.name, 1 - sizes[m.name] / plain, plain, sizes[m.name], " ".join(m.missing), " ".join(m.inserted)))
        return sorted(found)

    def _taken(self, text: list[str], start: int, end: int, matches: dict[str, set[Match]], low: int, high: int) -> list[Match]:
        """The notices of the block's license between two words, and of what is left beside them."""
        apart = {name: own for name, group in matches.items() if (own := _apart({m for m in group if low <= m.start and m.end <= high}))}
        if not apart or start >= end:
            return []
        plain, sizes = self.sizes(text[start:end])
        sound = _sound(apart)
        name = min(sound, key=lambda n: (sizes[n] - plain, n))  # the first by bytes saved whose wording is confirmed
        edges = [low, *(x for t in sorted(apart[name]) for x in (t.start, t.end)), high]
        return apart[name] + [m for a, b in zip(edges[::2], edges[1::2], strict=True) for m in self._taken(text, max(a, start), min(b, end), matches, a, b)]


def _agreement(m: Match) -> int:
    """Words that agree, less eight for each that does not."""
    return m.kept - 8 * (len(m.missing) + len(m.inserted))


def _sound(apart: dict[str, list[Match]]) -> set[str]:
    """The licenses that the wording confirms: those that agree with enough of it, and, where words differ, with the most."""
    agreeing = {name: sum(map(_agreement, own)) for name, own in apart.items()}
    most = max(agreeing.values())
    exact = {name for name, own in apart.items() if not any(m.missing or m.inserted for m in own)}
    return {name for name, n in agreeing.items() if n == most or (n >= AGREEING * most and name in exact)}


def _apart(matches: set[Match]) -> list[Match]:
    """The best of those that overlap."""
    taken: list[Match] = []
    for m in sorted(matches, key=lambda m: (-_agreement(m), m)):
        if all(m.end <= t.start or t.end <= m.start for t in taken):
            taken.append(m)
    return taken


def _scan(batches: Iterator[pa.RecordBatch], tolerance: float) -> Iterator[pa.RecordBatch]:
    scan = scanner(tolerance).scan
    for batch in batches:
        for a, b in row_slices(batch["text"]):
            rows = []
            for doc, text in zip(batch["doc_id"].slice(a, b - a).to_pylist(), batch["text"].slice(a, b - a).to_pylist(), strict=True):
                if found := scan(words(text)):
                    ends = list(accumulate(len(words(line)) for line in text.split("\n")))
                    rows += [(doc, bisect_right(ends, start), *rest) for start, *rest in found]
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in FOUND.split(", ")])


def find_licenses(docs: DataFrame, tolerance: float = 0.1) -> DataFrame:
    """One row for each notice of a license."""
    texts = docs.select(F.col("doc_id").cast("long"), "text").where(F.col("text").isNotNull())
    return texts.mapInArrow(lambda it: _scan(it, tolerance), FOUND)
