"""License scans: winnowed fingerprints of templates, an inverted index, and banded alignment.

Of the hashes of all runs of ``GRAM`` words, winnowing keeps the smallest of every
``SPAN`` neighbours, so any ``GRAM + SPAN - 1`` words that a text shares with a template
share a fingerprint. The templates' fingerprints form an inverted index, hash to (template,
place). Where a document's fingerprints hit it, the differences of the places name diagonals;
each cluster of them is aligned word by word within a band, and the best local alignment
gives the words of the template that are matched (coverage) and the span in the text. The
words that tell the license and its version from others (``MARKS``) must be in that span; a long
notice may lack one if no other license's stands there.

Whole license texts are looked for where a stretch holds a fifth of their fingerprints, and
are aligned there in the same way, a row of the band at a time.

The index depends on the templates alone, whose number of words is checked, and goes to
every task. Documents are scanned in one pass in Arrow batches, without a shuffle.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import cached_property
from importlib import resources

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairrank.functions.text import quoted
from pairrank.llm.expressions import columns_of
from pairrank.llm.minhash import hashed_words, mixed

GRAM, SPAN = 3, 3
COVERAGE = 0.8
# Words by which an alignment may drift from its diagonal, at least, and as a share of the template.
BAND, BAND_SHARE = 4, 0.1
MAX_TEMPLATE_WORDS = 1_000_000
# Share of a whole text's fingerprints that a stretch must hold to be looked at, far below what the least coverage leaves.
BODY_SCREEN = 0.2
# Words about the beginning of a whole text in which its title is, and characters of the text's own title.
TITLE_WORDS, TITLE_CHARS = 8, 100

# Notices by which licenses are named or granted, per SPDX identifier.
_BSD_CLAUSES = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
    "conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and "
    "the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of "
    "conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. ")
_BSD_WARRANTY = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, '
    "BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT "
    "SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL "
    "DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
    "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE "
    "OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
_BSD_NAMES = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
    "derived from this software without specific prior written permission.")

_BSD_ADVERTISING = (
    "3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product "
    "includes software developed by ")
_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
    'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, '
    "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
    "Software is furnished to do so")
_MIT_NOTICE = (
    ", subject to the following conditions: The above copyright notice and this permission notice "
    "shall be included in all copies or substantial portions of the Software.")
_X11_NAMES = (
    " Except as contained in this notice, the name of the copyright holders shall not be used in advertising or otherwise to promote "
    "the sale, use or other dealings in this Software without prior written authorization.")


def _only(name: str, version: str) -> str:
    """The terms of the same notice without a later version."""
    return f"under the terms of the GNU {name} version {version} as published by the Free Software Foundation."


def _creative(short: str, long: str) -> list[str]:
    return [f"Licensed under CC {short} 4.0.", f"This work is licensed under a Creative Commons {long} 4.0 International License."]


def _program(what: str, name: str, version: str, mark: str) -> str:
    """The notice that the FSF's licenses tell programs to carry."""
    return (f"This {what} is free software{mark} you can redistribute it and/or modify it under the terms of the GNU {name} as "
            f"published by the Free Software Foundation{',' if mark == ':' else ';'} either version {version} of the License, or (at your "
            "option) any later version.")


TEMPLATES = {
    "AGPL-3.0": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        _program("program", "Affero General Public License", "3", ":"),
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the '
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable "
        'law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES '
        "OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and "
        "limitations under the License.",
    ],
    "BSD-2-Clause": [_BSD_CLAUSES.strip(), _BSD_CLAUSES + _BSD_WARRANTY],
    "BSD-3-Clause": [
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        _BSD_NAMES, f"{_BSD_CLAUSES}3. {_BSD_NAMES} {_BSD_WARRANTY}",
    ],
    "BSD-4-Clause": [f"{_BSD_CLAUSES}{_BSD_ADVERTISING.strip()}", f"{_BSD_CLAUSES}{_BSD_ADVERTISING} 4. {_BSD_NAMES} {_BSD_WARRANTY}"],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC-BY-NC-ND-4.0": _creative("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
    "CC-BY-NC-SA-4.0": _creative("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
    "CC-BY-ND-4.0": _creative("BY-ND", "Attribution-NoDerivatives"),
    "CC-BY-SA-4.0": [
        "Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "EPL-2.0": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is "
        "available at https://www.eclipse.org/legal/epl-2.0",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        _program("program", "General Public License", "2", ";"), _only("General Public License", "2"),
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        _only("General Public License", "3"),
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "LGPL-2.1": [
        "This work is licensed under the GNU Lesser General Public License, version 2.1.",
        _program("library", "Lesser General Public License", "2.1", ";"),
    ],
    "LGPL-3.0": [
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        _program("library", "Lesser General Public License", "3", ":"),
    ],
    "MIT": [
        "Released under the MIT License.", "This project is licensed under the MIT License.",
        _MIT_GRANT + _MIT_NOTICE,
    ],
    "MIT-0": [_MIT_GRANT + "."],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
        "with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "X11": [_MIT_GRANT + _MIT_NOTICE + _X11_NAMES],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any "
        "damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including "
        "commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of "
        "this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in "
        "a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions "
        "must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be "
        "removed or altered from any source distribution.",
    ],
}

# The tag by which a file names its license stands for a notice as well.
TAG = "SPDX-License-Identifier:"
TEMPLATES = {name: [*texts, f"{TAG} {name}"] for name, texts in TEMPLATES.items()}

# The words that tell a license from its relatives. Those of them that a template has must stand in a match.
MARKS = {
    "AGPL-3.0": "gnu affero general public 3", "BSL-1.0": "boost 1 0", "EPL-2.0": "eclipse 2 0", "LGPL-2.1": "gnu lesser general public 2 1",
    "Apache-2.0": "apache 2 0", "BSD-2-Clause": "bsd 2", "BSD-3-Clause": "bsd 3", "CC-BY-4.0": "creative commons cc by attribution 4 0",
    "CC-BY-NC-4.0": "creative commons cc by attribution nc noncommercial 4 0", "CC-BY-SA-4.0": "creative commons cc by attribution sa sharealike 4 0",
    "BSD-4-Clause": "bsd 4 advertising acknowledgement", "X11": "x11 advertising promote",
    "CC-BY-NC-ND-4.0": "creative commons cc by attribution nc noncommercial nd noderivatives 4 0",
    "CC-BY-NC-SA-4.0": "creative commons cc by attribution nc noncommercial sa sharealike 4 0",
    "CC-BY-ND-4.0": "creative commons cc by attribution nd noderivatives 4 0",
    "CC0-1.0": "waived", "GPL-2.0": "gnu general public 2", "GPL-3.0": "gnu general public 3", "ISC": "isc", "LGPL-3.0": "gnu lesser general public 3",
    "MIT": "mit", "MPL-2.0": "mozilla 2 0", "Unlicense": "unencumbered",
}
# A template that names a license by its first word here is none of a license named with one of the others, if it has not got that itself.
_RELATIVES = {
    "gnu": "lesser library affero free documentation", "creative": "noncommercial commercial sharealike alike noderivatives noderivs derivatives derivs",
    "cc": "nc sa nd", "mit": "attribution modern", "bsd": "patent attribution clear",
}
_NAMES = {w for words in MARKS.values() for w in words.split() if not w.isdigit()} | {w for words in _RELATIVES.values() for w in words.split()} | {
    "academic", "artistic", "boost", "eclipse", "epl", "european", "gpl", "zlib"}
# Enumerations are digits too, so numbers count as marks only in templates of fewer words, or that name a version.
_SHORT = 25
# Before a short notice, or in it, these say that it is not granted.
_NEGATIONS = frozenset("not never nor isn aren neither".split())
_VERSION = re.compile(rb"\.([0-9]+)")

# Words are runs of ASCII letters and digits and of any other characters beyond ASCII.
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def split(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
    """Word hashes, their starts and ends in the text's UTF-8 bytes, and these bytes; A-Z count as lower case."""
    data = text.encode("utf-8", "surrogatepass")
    return *hashed_words(np.frombuffer(data.lower(), np.uint8), _WORD), data


def fingerprints(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Winnowed gram hashes and their places, in order."""
    if len(words) < GRAM:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    grams = np.zeros(len(words) - GRAM + 1, np.uint64)
    for j in range(GRAM):
        grams = mixed(grams * np.uint64(3) + words[j : len(grams) + j])
    if len(grams) <= SPAN:
        at = np.array([int(grams.argmin())])
    else:
        windows = np.lib.stride_tricks.sliding_window_view(grams, SPAN)
        # The rightmost of equal ones.
        at = np.unique(np.arange(len(windows)) + SPAN - 1 - windows[:, ::-1].argmin(1))
    return grams[at], at


def align(template: np.ndarray, words: np.ndarray, diagonal: int, band: int) -> tuple[int, int, int]:
    """The best local alignment with word j - i within ``band`` of ``diagonal``: words matched, and the span in ``words``.

    A match scores 2, a mismatch or a gap -1; of equal scores the one of more matched words wins, then the earliest end.
    """
    best, cells = (0, 0, 0, 0), {}
    template, lower, upper = template.tolist(), diagonal - band, diagonal + band
    # A cell holds score, matched words, and where the alignment began.
    for i, word in enumerate(template):
        row = {}
        first = max(0, i + lower)
        near = words[first : max(0, i + upper + 1)].tolist()
        for j, other in enumerate(near, first):
            score, matched, begin = cells.get(j - 1, (0, 0, j))
            equal = word == other
            options = [(score + 2, matched + 1, begin) if equal else (score - 1, matched, begin)]
            if j in cells:
                options.append((cells[j][0] - 1, *cells[j][1:]))
            if j - 1 in row:
                options.append((row[j - 1][0] - 1, *row[j - 1][1:]))
            cell = max(options, key=lambda c: (c[0], c[1], -c[2]))
            # An alignment whose score has fallen to zero is not dropped for a new one, which has matched less.
            if cell[0] >= 0 and cell[1]:
                row[j] = cell
                if equal and cell[:2] > best[:2]:
                    best = (cell[0], cell[1], cell[2], j + 1)
        cells = row
    return best[1:]


def align_long(template: np.ndarray, words: np.ndarray, slack: int) -> tuple[int, int, int]:
    """``align`` for whole texts: all diagonals between the two lengths, and ``slack`` more, a row at a time.

    A cell is one number: score, matched words and how late the alignment began, in this order.
    """
    size, drift = len(template), len(words) - len(template)
    lower, width = min(0, drift) - slack, abs(drift) + 2 * slack + 1
    point, match, late = 1 << 42, 1 << 22, (1 << 22) - 1
    offsets = np.arange(width)
    gaps = offsets * point
    none = np.full(1, -(1 << 61))
    row, best, end = np.full(width, none[0]), 0, 0
    for i in range(size):
        at = i + lower + offsets
        inside = (at >= 0) & (at < len(words))
        equal = inside & (words[np.clip(at, 0, len(words) - 1)] == template[i])
        # An alignment goes on, or begins here.
        begun = np.maximum(row, late - np.clip(at, 0, late))
        cells = np.where(equal, begun + 2 * point + match, np.maximum(row, none[0] + point) - point)
        cells = np.maximum(cells, np.concatenate((row[1:], none)) - point)
        # Words of the text that are passed over: the best cell before, less a point for each.
        cells = np.maximum(cells, np.maximum.accumulate(cells + gaps) - gaps)
        row = np.where(inside, np.maximum(cells, none[0] + point), none[0])
        top = int(np.where(equal, row, none[0]).argmax())
        if equal[top] and row[top] >> 22 > best >> 22:
            best, end = int(row[top]), int(at[top]) + 1
    return (best >> 22) & ((1 << 20) - 1), late - (best & late) if best else 0, end


def body_texts() -> dict[str, str]:
    """The whole texts of licenses, per SPDX identifier, from the package's folder or archive."""
    folder = resources.files("pairrank.llm") / "license_texts"
    return {f.name.removesuffix(".txt"): f.read_text(encoding="utf-8") for f in sorted(folder.iterdir(), key=lambda f: f.name)}


def marks_of(name: str, words: list[str]) -> tuple[set[str], set[str], set[str]]:
    """The words that a match of a template must hold, those it must not, and the version numbers of the template."""
    if words[:3] == ["spdx", "license", "identifier"]:
        # A tag is matched as it is.
        return set(words), {w for family, others in _RELATIVES.items() if family in words for w in others.split()} - set(words), {
            w for w in words if w.isdigit()}
    marks = set(MARKS.get(name, "").split()) & set(words)
    if len(words) >= _SHORT and "version" not in words and "v" not in words:
        marks = {w for w in marks if not w.isdigit()}
    foreign = {w for family, others in _RELATIVES.items() if family in words and marks for w in others.split()} - set(words)
    return marks, foreign, {w for w in marks if w.isdigit()}


class Index:
    """The inverted index of templates, a mapping of license name to notices, and of whole texts of licenses.

    The package's own texts go with its own notices unless ``bodies`` says otherwise.
    """

    def __init__(self, templates: dict[str, list[str]] = TEMPLATES, bodies: dict[str, str] | None = None):
        if bodies is None:
            bodies = body_texts() if templates is TEMPLATES else {}
        self.names = [name for name, texts in templates.items() for _ in texts]
        self.words = [split(text)[0] for texts in templates.values() for text in texts]
        self.bodies = [(name, split(text)[0]) for name, text in bodies.items()]
        self.body_prints = [np.unique(fingerprints(words)[0]) for _, words in self.bodies]
        self.body_foreign = [
            self._related - set(text[:TITLE_CHARS].lower().split()) if name.split("-")[0] in ("GPL", "LGPL", "GFDL") else set()
            for name, text in bodies.items()]
        if sum(map(len, self.words)) + sum(len(w) for _, w in self.bodies) > MAX_TEMPLATE_WORDS:
            raise ValueError(f"the templates have more than {MAX_TEMPLATE_WORDS} words")
        texts_of = [text for texts in templates.values() for text in texts]
        plain = [[data[b:e].decode("utf-8", "replace").lower() for b, e in zip(starts.tolist(), ends.tolist())]
                 for _, starts, ends, data in map(split, texts_of)]
        self.required, self.foreign, self.versions = zip(*map(marks_of, self.names, plain)) if plain else ((), (), ())
        self.own = [set(words) for words in plain]
        self.places = defaultdict(list)
        for t, words in enumerate(self.words):
            for print_, at in zip(*(x.tolist() for x in fingerprints(words))):
                self.places[print_].append((t, at))

    _related = frozenset(["affero", "lesser", "library"])

    @cached_property
    def body_known(self) -> np.ndarray:
        return np.unique(np.concatenate(self.body_prints)) if self.bodies else np.zeros(0, np.uint64)

    def whole_texts(self, prints: np.ndarray, at: np.ndarray, words: np.ndarray, word_of, coverage: float) -> list[tuple]:
        """Matches of whole license texts, as those of notices in ``scan``.

        Where enough of a text's fingerprints lie within its length, its words are aligned
        within a band about the diagonals that the two lengths leave.
        """
        if not self.bodies:
            return []
        known = np.minimum(np.searchsorted(self.body_known, prints), len(self.body_known) - 1)
        hits = self.body_known[known] == prints
        least = min(map(len, self.body_prints)) * BODY_SCREEN
        if hits.sum() < least:
            return []
        prints, at, found = prints[hits], at[hits], []
        for k, (_, text) in enumerate(self.bodies):
            mine = np.isin(prints, self.body_prints[k])
            places = at[mine]
            reach, need = int(len(text) * (1 + BAND_SHARE)), len(self.body_prints[k]) * BODY_SCREEN
            while len(places) >= need:
                # The stretch of the text's length with most of its fingerprints.
                count = np.searchsorted(places, places + reach) - np.arange(len(places))
                best = int(count.argmax())
                if count[best] < need:
                    break
                first, last = places[best], places[best + count[best] - 1]
                slack = int(len(text) * BAND_SHARE)
                low, high = max(0, int(first) - slack), int(last) + GRAM + slack
                matched, begin, end = align_long(text, words[low:high], slack)
                begin, end = low + begin, low + end
                if matched >= coverage * len(text):
                    title = {word_of(j) for j in range(max(0, begin - TITLE_WORDS), min(len(words), begin + TITLE_WORDS))}
                    if not title & self.body_foreign[k]:
                        found.append((-matched, -matched / len(text), len(self.names) + k, begin, end))
                places = places[(places < first) | (places > last)]
        return found

    @cached_property
    def known(self) -> np.ndarray:
        return np.sort(np.fromiter(self.places, np.uint64, len(self.places)))

    def of_this_license(self, t: int, starts: np.ndarray, ends: np.ndarray, data: bytes) -> bool:
        """Whether the words of a span are those of template ``t``'s license and version, not of a related one."""
        if not self.required[t]:
            return True
        words = [data[b:e].lower().decode("utf-8", "replace") for b, e in zip(starts.tolist(), ends.tolist())]
        # A GPL notice may speak of "this library"; the Library General Public License is another one.
        found = {w for w, after in zip(words, [*words[1:], ""]) if w != "library" or after == "general" or w in self.own[t]}
        missing = self.required[t] - found
        if missing and (len(self.words[t]) < _SHORT or len(missing) > 1 or missing & self._related) or self.foreign[t] & found:
            return False
        # A long notice may have lost a mark to an edit, but not have another one in its place.
        others = found - self.own[t]
        if missing & self.versions[t] and any(w.isdigit() for w in others) or missing - self.versions[t] and others & _NAMES:
            return False
        # 2.1 is not version 2, and 2.0 is.
        own = {"0", *self.versions[t]}
        for word, e in zip(words, ends.tolist()):
            minor = _VERSION.match(data, e) if word in self.versions[t] else None
            if minor and minor[1].decode() not in own:
                return False
        return True

    def negated(self, t: int, starts: np.ndarray, ends: np.ndarray, begin: int, end: int, data: bytes) -> bool:
        """Whether a short notice is denied, by a word in it or one of the two before it."""
        if len(self.words[t]) >= _SHORT:
            return False
        first = max(0, begin - 2)
        spoken = {data[b:e].lower().decode("utf-8", "replace") for b, e in zip(starts[first:end].tolist(), ends[first:end].tolist())}
        return bool(spoken & _NEGATIONS - self.own[t])

    def scan(self, text: str | None, coverage: float = COVERAGE) -> list[tuple[str, float, int, int, int]]:
        """License, coverage, matched words, and span [start, end) in code points, in text order.

        Of overlapping matches the one with more matched words stays, then the one of higher
        coverage, then the earlier template.
        """
        if not text or not len(self.known):
            return []
        words, starts, ends, data = split(text)
        prints, at = fingerprints(words)
        near = np.minimum(np.searchsorted(self.known, prints), len(self.known) - 1)
        hits = np.flatnonzero(self.known[near] == prints)
        found = self.whole_texts(prints, at, words, lambda j: data[starts[j] : ends[j]].lower().decode("utf-8", "replace"), coverage)
        if not len(hits) and not found:
            return []
        diagonals = defaultdict(set)
        for print_, place in zip(prints[hits].tolist(), at[hits].tolist()):
            for t, q in self.places[print_]:
                diagonals[t].add(place - q)
        for t, seen in diagonals.items():
            size = len(self.words[t])
            band = max(BAND, int(BAND_SHARE * size))
            last = None
            for diagonal in sorted(seen):
                # Diagonals within a band of one already aligned are covered by it.
                if last is not None and diagonal - last <= band:
                    continue
                last = diagonal
                matched, begin, end = align(self.words[t], words, diagonal, 2 * band)
                if matched >= coverage * size and not self.negated(t, starts, ends, begin, end, data) and self.of_this_license(
                        t, starts[begin:end], ends[begin:end], data):
                    found.append((-matched, -matched / size, t, begin, end))
        taken: list[tuple[int, int, int, float, int]] = []
        for matched, share, t, begin, end in sorted(found):
            if all(end <= b or begin >= e for _, b, e, _, _ in taken):
                taken.append((t, begin, end, -share, -matched))
        code_points = np.concatenate(([0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)))
        names = [*self.names, *(name for name, _ in self.bodies)]
        return [(names[t], share, matched, int(code_points[starts[b]]), int(code_points[ends[e - 1]]))
                for t, b, e, share, matched in sorted(taken, key=lambda x: x[1])]


MATCHES = "array<struct<license: string, coverage: double, matched: int, start: int, end: int>>"


def scanned(text: Column, index: Index, coverage: float) -> Column:
    @F.pandas_udf(MATCHES)
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([index.scan(t, coverage) for t in texts])

    return scan(text)


def scan_licenses(documents: DataFrame, templates: dict[str, list[str]] = TEMPLATES, coverage: float = COVERAGE, text: str = "text") -> DataFrame:
    """``documents`` with ``matches``: license, coverage of its template, matched words and span of every notice found.

    Whole texts of licenses (``body_texts``) go with the package's own templates. A whole text
    takes the place of the notices in it. Spans count code points of the whole text. At least ``coverage`` of a template's words
    must be matched in order, and the span must hold its marks. A null or empty text, and one without notices, has no matches;
    repeated rows are scanned each for itself. An input column named matches is replaced.
    """
    if not 0 < coverage <= 1:
        raise ValueError("coverage is above 0 and at most 1")
    own = columns_of(documents, "matches")
    return documents.select(*own, scanned(quoted(text), Index(templates), coverage).alias("matches"))
