"""License scans: winnowed template fingerprints pick candidates, banded alignment measures them.

Words are maximal runs of ASCII letters and digits in lower case. Of each template's grams, winnowing
keeps the smallest hash of every window of neighbours, so a run of gram + window - 1 words that a
text shares with a template holds a kept gram. Templates of less than SHORT words keep all grams of two words:
a local alignment with a gap or mismatch has two matched words in a row, so each has a hit. For longer
ones gram and window follow from the least coverage: where only as many words are lost as it admits,
some run of the others is long enough. The kept grams are
an inverted index from gram to (template, place); templates are a parameter and few, so the
index goes with the task. All grams of a text are looked up. Hits of one template on
near diagonals are one candidate, unless the band around them lacks the words; a local alignment inside the band around them
(match 1, mismatch and gap -1) gives the matched words, the coverage (matched words over the
template's words) and the span in code points. Of overlapping spans of one template the
best stays.

A null text counts as empty and matches nothing, a null doc_id stays null, repeated rows
give repeated matches, other columns are ignored, an empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from skein.llm.common import arrow, arrow_schema, id_text, mix, public_id

GRAM = 3  # words at most
SHORT = 15  # words from which a template's grams are winnowed
BAND = 16  # words by which an alignment may leave the diagonals of its hits
COVERAGE = 0.8  # least share of a template's words

# Usual wording of notices and licence texts.
TEMPLATES = {
    "MIT notice": "Released under the MIT License.",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0 notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0 notice": (
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."
    ),
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        'associated documentation files (the "Software"), to deal in the Software without restriction, including '
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all "
        'copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY '
        "KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A "
        "PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR "
        "ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, "
        "OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met: 1. Redistributions of source code must retain the above copyright "
        "notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must "
        "reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright "
        "holder nor the names of its contributors may be used to endorse or promote products derived from this "
        "software without specific prior written permission."
    ),
    "Apache-2.0 header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR '
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License."
    ),
    "GPL header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the "
        "GNU General Public License for more details."
    ),
    "MPL-2.0 header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
        "was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
}

WORD = re.compile(r"[A-Za-z0-9]+")


def words_of(text: str) -> list[str]:
    return list(map(str.lower, WORD.findall(text)))


def grams_of(length: int, least: float) -> tuple[int, int]:
    """Words of a gram, and neighbouring grams of which one is kept, for a template of ``length`` words."""
    if length < SHORT:
        return max(1, min(2, length)), 1
    matched = math.ceil(least * length - 1e-9)
    run = max(1, -(-matched // (length - matched + 1)))  # the longest one is no shorter
    gram = min(GRAM, run)
    return gram, min(GRAM, run - gram + 1)


def winnow(grams: np.ndarray, window: int) -> list[int]:
    """Places of the kept grams: of each ``window`` neighbours the one with the smallest hash, the last of equals."""
    hashes = mix(grams)
    kept: list[int] = []
    for lo in range(max(1, len(grams) - window + 1)):
        part = hashes[lo : lo + window]
        at = lo + len(part) - 1 - int(np.argmin(part[::-1]))
        if not kept or kept[-1] != at:
            kept.append(at)
    return kept


class Index:
    """Template words by number, and the inverted index of kept grams."""

    def __init__(self, templates: Mapping[str, str], least: float = COVERAGE):
        split = {name: words_of(text) for name, text in templates.items()}
        self.numbers = {w: i + 1 for i, w in enumerate(sorted({w for ws in split.values() for w in ws}))}
        self.names = list(split)
        self.templates = [self.number(ws) for ws in split.values()]
        self.words = [frozenset(words.tolist()) for words in self.templates]
        self.least = [least * len(words) for words in self.templates]
        self.places: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for t, words in enumerate(self.templates):
            size, window = grams_of(len(words), least)
            grams = self.grams(words, size)
            for at in winnow(grams, window) if len(grams) else ():
                self.places[size][int(grams[at])].append((t, at))
        self.known = {size: np.array(sorted(found), np.uint64) for size, found in self.places.items()}

    def number(self, words: list[str]) -> np.ndarray:
        """Template word numbers; 0 for words of no template."""
        return np.array([self.numbers.get(w, 0) for w in words], np.uint64)

    def grams(self, numbers: np.ndarray, size: int) -> np.ndarray:
        """``size`` words in one number; 0 if one of them is in no template."""
        n = len(numbers) - size + 1
        if n < 1:
            return np.zeros(0, np.uint64)
        base, out, whole = np.uint64(len(self.numbers) + 1), np.zeros(n, np.uint64), np.ones(n, bool)
        for j in range(size):
            part = numbers[j : j + n]
            out = out * base + part
            whole &= part > 0
        return np.where(whole, out, np.uint64(0))

    def candidates(self, numbers: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(template, lowest diagonal, highest diagonal): the band around near hits."""
        diagonals: dict[int, set[int]] = defaultdict(set)
        for size, known in self.known.items():
            grams, places = self.grams(numbers, size), self.places[size]
            hits = np.flatnonzero(np.isin(grams, known))
            for at, gram in zip(hits.tolist(), grams[hits].tolist()):
                for t, place in places[gram]:
                    diagonals[t].add(at - place)
        for t, found in diagonals.items():
            ordered = sorted(found)
            low, band = ordered[0], self.band(t)
            for a, b in zip(ordered, [*ordered[1:], None]):
                if b is None or b - a > band:
                    if self.holds(t, numbers, low - band, a + band):
                        yield t, low - band, a + band
                    low = b

    def holds(self, t: int, numbers: np.ndarray, low: int, high: int) -> bool:
        """Whether the band has as many words of the template as a match needs."""
        part = numbers[max(0, low) : high + len(self.templates[t])].tolist()
        return sum(map(self.words[t].__contains__, part)) >= self.least[t]

    def band(self, t: int) -> int:
        """Narrower for short templates, so that copies next to each other stay apart."""
        return min(BAND, len(self.templates[t]) // 2)


def align(template: np.ndarray, numbers: np.ndarray, low: int, high: int) -> tuple[int, int, int]:
    """(matched words, first word, last word + 1) of the best local alignment between two diagonals.

    Row i of the table is template word i, column c is text word i + low + c; a step down keeps the
    text word, so it goes one column to the left.
    """
    width = high - low + 1
    table = np.zeros((len(template) + 1, width + 1), np.int32)
    ramp = np.arange(width, dtype=np.int32)
    for i, word in enumerate(template, 1):
        at = np.arange(width) + (i - 1 + low)
        inside = (at >= 0) & (at < len(numbers))
        same = np.zeros(width, bool)
        same[inside] = numbers[at[inside]] == word
        diagonal = table[i - 1, :width] + np.where(same, 1, -1)
        up = table[i - 1, 1:] - 1
        best = np.maximum(np.maximum(diagonal, up), 0)
        best[~inside] = 0
        best = np.maximum.accumulate(best + ramp) - ramp  # gaps along the text
        best[~inside] = 0
        table[i, :width] = best
    i, c = map(int, np.unravel_index(int(table.argmax()), table.shape))
    matched, last, first = 0, None, 0
    while table[i, c] > 0:
        at = i - 1 + low + c
        same = bool(numbers[at] == template[i - 1])
        if table[i, c] == table[i - 1, c] + (1 if same else -1):
            if same:
                matched, first = matched + 1, at
                last = at + 1 if last is None else last
            i -= 1
        elif c < width and table[i, c] == table[i - 1, c + 1] - 1:
            i, c = i - 1, c + 1
        else:
            c -= 1
    return matched, first, last or first


def matches(index: Index, text: str, least: float) -> list[tuple[str, float, int, int, int]]:
    """(template, coverage, matched words, start, end) by start, then template."""
    numbers = index.number(words_of(text))
    best: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    for t, low, high in index.candidates(numbers):
        template = index.templates[t]
        matched, first, last = align(template, numbers, low, high)
        if matched >= least * len(template):
            best[t].append((matched, first, last))
    if not best:
        return []
    places = [m.span() for m in WORD.finditer(text)]
    out = []
    for t, found in best.items():
        taken: list[tuple[int, int]] = []
        for matched, first, last in sorted(found, key=lambda m: (-m[0], m[1])):
            if all(last <= a or b <= first for a, b in taken):
                taken.append((first, last))
                coverage = matched / len(index.templates[t])
                out.append((index.names[t], coverage, matched, places[first][0], places[last - 1][1]))
    return sorted(out, key=lambda m: (m[3], m[0]))


SCHEMA = "did long, template string, coverage double, matched long, start long, end long"


def scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, coverage: float = COVERAGE) -> DataFrame:
    """One row per match: doc_id, template, coverage, matched words, span in code points."""
    target = arrow_schema(docs.sparkSession, SCHEMA)

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(templates, coverage)
        for batch in batches:
            rows = [
                (did, *match)
                for did, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                for match in matches(index, text, coverage)
            ]
            if rows:
                yield arrow(rows, target)

    out = id_text(docs).mapInArrow(task, SCHEMA)
    return out.select(public_id(), *out.columns[1:])
