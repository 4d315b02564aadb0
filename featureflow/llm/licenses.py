"""License scans: winnowed fingerprints pick candidates, banded alignment reports coverage and spans.

Templates are cut into words; hashes of word k-grams are winnowed, so that any k + w - 1 words in common
share a fingerprint, and stored in an inverted index. A text looks up its k-grams; hits on nearby
diagonals make one candidate, whose words are aligned with the template inside a band.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

GRAM = 3
WINDOW = 2
COVERAGE = 0.8
# Diagonals on either side of a candidate's first one, besides one in ten words of the template.
BAND = 4
_WORD = re.compile(r"[^\W_]+")

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this
permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS
IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND
THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION,
ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and
the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and
the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_3 = """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN
NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR
PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT
(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF
SUCH DAMAGE."""

# Public license texts and the usual notices that name a license.
TEMPLATES = {
    "mit": _MIT,
    "isc": _ISC,
    "bsd-2-clause": f"{_BSD_2} {_BSD_END}",
    "bsd-3-clause": f"{_BSD_2} {_BSD_3} {_BSD_END}",
    "apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law
or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF
ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the
License.""",
    "gpl-3.0-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This
program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "mpl-2.0-header": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
non-commercial, and by any means.""",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0",
    "mit-notice": "Released under the MIT License",
    "mit-notice-licensed": "Licensed under the MIT License",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3",
    "gpl-2.0-notice": "This work is licensed under the GNU General Public License, version 2",
    "cc-by-4.0-notice": "Licensed under CC BY 4.0",
    "cc-by-sa-4.0-notice": "Licensed under CC BY-SA 4.0",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "cc-by-nc-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
}


class Match(NamedTuple):
    license: str
    coverage: float
    start: int
    end: int


def winnow(hashes: list[int], window: int) -> list[int]:
    """Places of the smallest hash (the last of equal ones) of each window; a short list is one window."""
    span = min(window, len(hashes))
    return sorted({min(range(i, i + span), key=lambda j: (hashes[j], -j)) for i in range(len(hashes) - span + 1)}) if span else []


def align(template: np.ndarray, words: np.ndarray, shift: int, band: int) -> tuple[int, int, int]:
    """Most template words matched in order inside a band of diagonals around `shift` (text place minus template
    place), with the first and last matching text place; (0, 0, 0) if none match. Of equal counts the later start, then the shorter span."""
    width = 2 * band + 1
    empty = (0, -1, -1)  # matches, first, last
    above = [empty] * (width + 1)
    for i, word in enumerate(template.tolist()):
        row, left = [empty] * (width + 1), empty
        for d in range(width):
            j = i + shift - band + d
            best = max(left, above[d + 1], key=_score)  # skip a word of the text, or of the template
            if 0 <= j < len(words) and words[j] == word:
                count, first, _ = above[d]
                best = max((count + 1, first if count else j, j), best, key=_score)
            row[d] = left = best
        above = row
    count, first, last = max(above, key=_score)
    return (count, first, last) if count else (0, 0, 0)


def _score(cell: tuple[int, int, int]) -> tuple[int, int, int]:
    return cell[0], cell[1], -cell[2]


class Scanner:
    """Templates with their inverted index of winnowed k-grams."""

    def __init__(self, templates: dict[str, str], gram: int = GRAM, window: int = WINDOW, coverage: float = COVERAGE):
        self.names, self.gram, self.coverage = list(templates), gram, coverage
        cut = [_WORD.findall(t.lower()) for t in templates.values()]
        self.ids = {w: i + 1 for i, w in enumerate(sorted({w for words in cut for w in words}))}
        self.templates = [np.array([self.ids[w] for w in words], np.int64) for words in cut]
        self.base = len(self.ids) + 1
        self.index: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for t, words in enumerate(self.templates):
            grams = self._grams(words)
            # an odd multiplier spreads neighbouring ids before the smallest is chosen
            mixed = [int(g) * 0x9E3779B97F4A7C15 % (1 << 64) for g in grams]
            for place in winnow(mixed, window):
                self.index[int(grams[place])].append((t, place))
        self.stored = np.array(sorted(self.index), np.int64)

    def _grams(self, ids: np.ndarray) -> np.ndarray:
        n = len(ids) - self.gram + 1
        out = np.zeros(max(0, n), np.int64)
        for k in range(self.gram):
            out = out * self.base + ids[k : k + len(out)]
        return out

    def scan(self, text: str | None) -> list[Match]:
        """Matches by start, then name; of overlapping matches of one template the fullest, and none inside a fuller one."""
        text = text or ""
        words = _WORD.findall(text.lower())
        get = self.ids.get
        ids = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
        grams = self._grams(ids)
        if not len(grams) or not len(self.stored):
            return []
        at = np.minimum(np.searchsorted(self.stored, grams), len(self.stored) - 1)
        hits = np.nonzero(self.stored[at] == grams)[0]
        if not len(hits):
            return []
        diagonals: dict[int, list[int]] = defaultdict(list)
        for p in hits.tolist():
            for t, q in self.index[int(grams[p])]:
                diagonals[t].append(p - q)
        found: list[tuple[int, int, int, int]] = []
        for t, shifts in diagonals.items():
            size = len(self.templates[t])
            band = BAND + size // 10
            kept: list[tuple[int, int, int]] = []
            shifts.sort()
            previous = None
            for shift in shifts:
                if previous is not None and shift - previous <= band:
                    continue  # the band around the previous diagonal holds it
                previous = shift
                low = max(0, shift - band)
                count, first, last = align(self.templates[t], ids[low : shift + size + band], shift - low, band)
                if count >= self.coverage * size:
                    kept.append((count, first + low, last + low))
            found += [(count, first, last, t) for count, first, last in _apart(kept)]
        if not found:
            return []
        spans = _spans(text)
        best = _outermost(sorted(found, key=lambda m: (m[1], -m[2], -m[0], m[3])))
        matches = [Match(self.names[t], count / len(self.templates[t]), spans[a][0], spans[b][1]) for count, a, b, t in best]
        return sorted(matches, key=lambda m: (m.start, m.license))


def _apart(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of each run of overlapping spans those that match most, none overlapping another."""
    out, run, reach = [], [], -1
    for m in [*sorted(found, key=lambda m: m[1:]), None]:
        if m is None or m[1] > reach:
            chosen: list[tuple[int, int, int]] = []
            for x in sorted(run, key=lambda m: (-m[0], m[1])):
                if all(x[2] < c[1] or x[1] > c[2] for c in chosen):
                    chosen.append(x)
            out += chosen
            run = []
        if m is not None:
            run.append(m)
            reach = max(reach, m[2])
    return out


def _outermost(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Without matches inside the span of one that matches more words; sorted by start."""
    out, around = [], []
    for m in found:
        around = [x for x in around if x[2] >= m[1]]
        if not any(x[2] >= m[2] and x[0] > m[0] for x in around):
            out.append(m)
        around.append(m)
    return out


def _spans(text: str) -> list[tuple[int, int]]:
    """Code point spans of the words; lower case may be longer than the text, so places are carried over letter by letter."""
    low = text.lower()
    if len(low) == len(text):
        return [m.span() for m in _WORD.finditer(low)]
    origin = [i for i, c in enumerate(text) for _ in c.lower()]
    return [(origin[m.start()], origin[m.end() - 1] + 1) for m in _WORD.finditer(low)]


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: dict[str, str] | None = None, gram: int = GRAM,
         window: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """One row per match: doc_id, license, coverage, start_pos, end_pos.

    coverage is the share of template words matched in order, at least `coverage`; positions are code
    points of the whole text, the end exclusive. Several occurrences in a text are several rows; a match inside
    the span of one that matches more words is left out. Null and empty texts have no match. Rows stand alone: no shuffle, repeated rows give their
    matches each, null ids are kept, other columns are not returned; an empty table gives no row. The index
    holds the templates only, and goes to the tasks with the function.
    """
    scanner = Scanner(TEMPLATES if templates is None else templates, gram, window, coverage)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, take = [], []
            for row, value in enumerate(batch.column(1)):
                for match in scanner.scan(value.as_py()):
                    out.append(match)
                    take.append(row)
            names, shares, starts, ends = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(take, pa.int64())), pa.array(names, pa.string()), pa.array(shares, pa.float64()),
                 pa.array(starts, pa.int64()), pa.array(ends, pa.int64())],
                names=["doc_id", "license", "coverage", "start_pos", "end_pos"],
            )

    fields = [rows.schema["doc_id"], T.StructField("license", T.StringType()), T.StructField("coverage", T.DoubleType())]
    fields += [T.StructField(n, T.LongType()) for n in ("start_pos", "end_pos")]
    return rows.mapInArrow(run, T.StructType(fields))
