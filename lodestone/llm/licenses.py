"""License scans: winnowed fingerprints, an inverted index, then banded alignment.

Templates and texts are cut into lower-case words of letters and digits. Of
the hashes of every window of consecutive k-grams the smallest is kept
(winnowing), which finds any shared run of ``k + window - 1`` words. The
templates' fingerprints form an inverted index of bounded size that is
broadcast; texts that hit a template at some diagonal are aligned with it
inside a band around that diagonal, and matched coverage and spans are reported.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.ngram_join import U, WordHashes, mix

#: Notices and opening or full texts of well-known licences.
TEMPLATES = {
    "mit-notice": "Released under the MIT License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0",
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "gpl-3.0-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.""",
}

GNU = {"gpl": ("General", "1 2 3"), "lgpl": ("Lesser General", "2.1 3"), "library-gpl": ("Library General", "2"), "agpl": ("Affero General", "3")}
GNU_DATES = {"gpl-1.0": "February 1989", "gpl-2.0": "June 1991", "gpl-3.0": "29 June 2007", "lgpl-2.1": "February 1999", "lgpl-3.0": "29 June 2007", "library-gpl-2.0": "June 1991", "agpl-3.0": "19 November 2007"}
CLAUSE_2 = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
CLAUSE_3 = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
NO_WARRANTY = """ THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""


def _common() -> dict[str, str]:
    """Further licences and versions: short notices, headers, opening or full texts."""
    out = {
        "bsd-2-clause": CLAUSE_2 + NO_WARRANTY,
        "bsd-3-clause": CLAUSE_2 + CLAUSE_3 + NO_WARRANTY,
        "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "apache-2.0-text": "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions.",
        "cc0-1.0-text": "Creative Commons Legal Code CC0 1.0 Universal",
        "cc0-1.0-notice": "Licensed under CC0 1.0 Universal",
    }
    for name, title in {"bsd": "BSD", "bsd-2-clause": "BSD 2-Clause", "bsd-3-clause": "BSD 3-Clause", "isc": "ISC", "apache": "Apache", "zlib": "zlib"}.items():
        out[f"{name}-notice"] = f"Released under the {title} License."
    for name, title, versions in (("apache", "Apache", "1.0 1.1"), ("mpl", "Mozilla Public", "1.0 1.1 2.0"), ("epl", "Eclipse Public", "1.0 2.0")):
        for version in versions.split():
            out[f"{name}-{version}-notice"] = f"Licensed under the {title} License, Version {version}"
    for version in ("1.0", "2.0", "2.5", "3.0", "4.0"):
        for kind in ("by", "by-sa", "by-nd", "by-nc", "by-nc-sa", "by-nd-nc" if version == "1.0" else "by-nc-nd"):
            out[f"cc-{kind}-{version}-notice"] = f"Licensed under CC {kind.upper()} {version}"
    for short, (kind, versions) in GNU.items():
        title, thing = f"GNU {kind} Public License", "library" if short in ("lgpl", "library-gpl") else "program"
        for version in versions.split():
            name = f"{short}-{version if '.' in version else version + '.0'}"
            out[f"{name}-notice"] = f"This work is licensed under the {title}, version {version}."
            out[f"{name}-notice-2"] = f"Licensed under the {title}, version {version if '.' in version else version + '.0'}"
            out[f"{name}-header"] = f"This {thing} is free software; you can redistribute it and/or modify it under the terms of the {title} as published by the Free Software Foundation; either version {version} of the License, or (at your option) any later version. This {thing} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {title} for more details. You should have received a copy of the {title} along with this {thing}"
            out[f"{name}-text"] = f"{title} Version {version}, {GNU_DATES[name]} Copyright (C) {GNU_DATES[name].split()[-1]} Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
    return out


TEMPLATES = _common() | TEMPLATES

#: What of a licence a template is: the part of its name after the licence and version.
KIND = re.compile(r"-(notice|header|text)(?:-\d+)?$")

WORD = re.compile(r"[^\W_]+")
K, WINDOW, BAND = 3, 2, 8
Occurrence = tuple[str, float, int, int, int]
#: Rivals found so far, by templates and least coverage: finding them scans every template.
RIVALS: dict[tuple, dict[str, list[str]]] = {}


def words_with_places(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    found = [(m[0].lower(), m.span()) for m in WORD.finditer(text)]
    return [w for w, _ in found], [s for _, s in found]


def gram_hashes(words: list[str], memo: WordHashes) -> np.ndarray:
    """Hash of every run of K words."""
    n = len(words) - K + 1
    if n <= 0:
        return np.zeros(0, U)
    h = np.fromiter(map(memo.__getitem__, words), U, len(words))
    rolled = np.full(n, K, U)
    for i in range(K):
        rolled = rolled * U(0x9E3779B97F4A7C15) + h[i : i + n]
    return mix(rolled)


def winnow(hashes: np.ndarray, window: int = WINDOW) -> list[int]:
    """Positions of the rightmost least hash of every window; fewer hashes than a window are one window."""
    kept = set()
    for i in range(max(1, len(hashes) - window + 1) if len(hashes) else 0):
        part = hashes[i : i + window]
        kept.add(i + int(np.flatnonzero(part == part.min())[-1]))
    return sorted(kept)


def align(template: list[str], words: list[str | None], diagonal: int, band: int = BAND) -> tuple[int, int, int]:
    """(matched words, first, end) of the best banded local alignment: text position = template position + diagonal, give or take the band.

    A match scores 2, a gap or mismatch -1. Ties go to the earliest end. No
    alignment crosses a place of the text that is None.
    """
    width = 2 * band + 1
    score, matched, begin = np.zeros((3, width), np.int64)
    begin[:] = -1
    best = (0, 0, 0, 0)
    for i, want in enumerate(template):
        left = (0, 0, -1)
        new = []
        for o in range(width):
            j = i + diagonal - band + o
            if not 0 <= j < len(words) or words[j] is None:
                new.append((0, 0, -1))
                left = (0, 0, -1)
                continue
            s, m, b = int(score[o]), int(matched[o]), int(begin[o])
            if words[j] == want:
                here = (s + 2, m + 1, b if s > 0 else j)
            else:
                here = (s - 1, m, b)
            if o + 1 < width and score[o + 1] - 1 > here[0]:
                here = (int(score[o + 1]) - 1, int(matched[o + 1]), int(begin[o + 1]))
            if left[0] - 1 > here[0]:
                here = (left[0] - 1, left[1], left[2])
            if here[0] <= 0:
                here = (0, 0, -1)
            new.append(here)
            left = here
            if here[0] > best[0]:
                best = (here[0], here[1], here[2], j + 1)
        score, matched, begin = (np.array(x) for x in zip(*new, strict=True))
    return best[1], best[2], best[3]


#: Diagonals that are aligned together, and from how many on that pays.
TOGETHER, FEW = 2048, 12


def align_many(template: list[str], words: list[str | None], diagonals: list[int], band: int = BAND) -> list[tuple[int, int, int]]:
    """``align`` at many diagonals: the bands go through the template side by side, a row of all of them at a time."""
    number = {w: i for i, w in enumerate(template)}
    text = np.array([-2 if w is None else number.get(w, -1) for w in words] + [-2], np.int64)
    out: list[tuple[int, int, int]] = []
    width = 2 * band + 1
    for part in range(0, len(diagonals), TOGETHER):
        near = np.array(diagonals[part : part + TOGETHER], np.int64) - band
        score, matched, begin = np.zeros((3, width + 1, len(near)), np.int64)
        begin[:] = -1
        # Beyond the band nothing comes from above: its score keeps any step from being taken.
        score[width] = -9
        best, held, first, end = np.zeros((4, len(near)), np.int64)
        for i, want in enumerate(template):
            left = (np.zeros(len(near), np.int64),) * 2 + (np.full(len(near), -1),)
            for o in range(width):
                j = near + (i + o)
                word = text[np.where((j >= 0) & (j < len(words)), j, -1)]
                same = word == number[want]
                s, m, b = score[o], matched[o], begin[o]
                b = np.where(same & (s <= 0), j, b)
                s, m = np.where(same, s + 2, s - 1), np.where(same, m + 1, m)
                for others in ((score[o + 1], matched[o + 1], begin[o + 1]), left):
                    step = others[0] - 1 > s
                    if step.any():
                        s, m, b = (np.where(step, x, y) for x, y in zip((others[0] - 1, *others[1:]), (s, m, b), strict=True))
                gone = (s <= 0) | (word == -2)
                s, m, b = np.where(gone, 0, s), np.where(gone, 0, m), np.where(gone, -1, b)
                score[o], matched[o], begin[o] = left = (s, m, b)
                more = s > best
                best, held, first, end = np.where(more, s, best), np.where(more, m, held), np.where(more, b, first), np.where(more, j + 1, end)
        out += zip(held.tolist(), first.tolist(), end.tolist(), strict=True)
    return out


class Scanner:
    """Templates (of K words at least), their inverted index, and the scan of one text."""

    def __init__(self, templates: dict[str, str], least_coverage: float, rivals: dict[str, list[str]] | None = None):
        self.names = sorted(templates)
        self.words = [words_with_places(templates[n])[0] for n in self.names]
        if any(len(w) < K for w in self.words):
            raise ValueError(f"a template needs {K} words")
        self.memo = WordHashes()
        self.index: dict[int, list[tuple[int, int]]] = {}
        for t, words in enumerate(self.words):
            hashes = gram_hashes(words, self.memo)
            for at in winnow(hashes):
                self.index.setdefault(int(hashes[at]), []).append((t, at))
        self.known = np.array(sorted(self.index), U)
        self.least = least_coverage
        self.rivals = rivals
        if rivals is None:
            key = (tuple(sorted(templates.items())), least_coverage)
            if key not in RIVALS:
                RIVALS[key] = self.find_rivals(templates)
            self.rivals = RIVALS[key]

    def occurrences(self, template: list[str], words: list[str], left: list[tuple[int, int]]) -> Iterator[tuple[int, int, int]]:
        """(matched words, first, end) of disjoint alignments, from sorted (diagonal, place) hits.

        An alignment finds one span of its band, so what was found is walled off
        and the hits outside are aligned again, until they find nothing new.
        """
        words = list(words)
        while left:
            reach, centres = None, []
            for diagonal, _ in left:
                if reach is None or diagonal > reach:
                    reach = diagonal + BAND
                    centres.append(reach - BAND // 2)
            aligned = align_many(template, words, centres) if len(centres) > FEW else [align(template, words, c) for c in centres]
            own = {(-matched, first, end) for matched, first, end in aligned if matched and matched / len(template) >= self.least}
            if not own:
                return
            for negative, first, end in sorted(own):
                if None not in words[first:end]:
                    words[first:end] = [None] * (end - first)
                    yield -negative, first, end
            left = [x for x in left if None not in words[x[1] : x[1] + K]]

    def find_rivals(self, templates: dict[str, str]) -> dict[str, list[str]]:
        """For each template the others whose own text is taken for it; notices, headers and texts of one licence are no rivals."""
        out: dict[str, list[str]] = {}
        for name, text in templates.items():
            licence, kind = KIND.sub("", name), KIND.findall(name)
            for other in {x[0] for x in self.scan_all(text)} - {name}:
                if KIND.sub("", other) != licence or KIND.findall(other) == kind:
                    out.setdefault(other, []).append(name)
        return out

    def scan(self, text: str) -> list[Occurrence]:
        """(license, coverage, matched words, first character, end) of every occurrence; overlapping ones of one license or of rivals count once, the best."""
        kept: dict[str, list[tuple[int, int]]] = {}
        out = []
        for one in sorted(self.scan_all(text), key=lambda x: (-x[2], -x[1], x[0], x[3])):
            name, _, _, first, end = one
            for rival in self.rivals.get(name, ()):
                spans = kept.get(rival, [])
                at = bisect.bisect_left(spans, (end, -1))
                if at and spans[at - 1][1] > first:
                    break
            else:
                bisect.insort(kept.setdefault(name, []), (first, end))
                out.append(one)
        return sorted(out, key=lambda x: (x[3], x[0]))

    def scan_all(self, text: str) -> list[Occurrence]:
        """Every occurrence, those of rivals included."""
        hashes = gram_hashes([w.lower() for w in WORD.findall(text)], self.memo)
        spots = np.flatnonzero(np.isin(hashes, self.known))
        if not len(spots):
            return []
        words, places = words_with_places(text)
        hits: dict[int, list[tuple[int, int]]] = {}
        for at in spots.tolist():
            for t, where in self.index[int(hashes[at])]:
                hits.setdefault(t, []).append((at - where, at))
        found = []
        for t, left in hits.items():
            for matched, first, end in self.occurrences(self.words[t], words, sorted(left)):
                found.append((self.names[t], matched / len(self.words[t]), matched, places[first][0], places[end - 1][1]))
        return found


def scan_licenses(docs: DataFrame, keep: list[str], templates: dict[str, str] | None = None, least_coverage: float = 0.8, text_col: str = "text") -> DataFrame:
    """Columns ``keep`` with one row per occurrence: license, coverage, matched_words, first_char, end_char.

    ``coverage`` is the share of the template's words that the alignment
    matches; the span is in characters of the text, end exclusive. A null or
    empty text has none. Repeated rows give repeated results. Every place of
    every text is looked up: nothing is cut off. Of overlapping occurrences of
    templates that are taken for each other (versions, variants) the best stays.
    Columns kept may not be named ``_text`` or like those that are added. An
    empty table gives none.
    """
    held = dict(TEMPLATES if templates is None else templates)
    rivals = Scanner(held, least_coverage).rivals
    chosen = docs.where(F.col(text_col).isNotNull()).select(*keep, F.col(text_col).alias("_text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1]), "license string, coverage double, matched_words int, first_char int, end_char int"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(held, least_coverage, rivals)
        for batch in batches:
            row, found = [], []
            for i, text in enumerate(batch.column("_text")):
                for one in scanner.scan(text.as_py()):
                    row.append(i)
                    found.append(one)
            columns = list(zip(*found, strict=True)) if found else [[]] * 5
            kinds = (pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(row, pa.int64())) for k in keep), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=[*keep, "license", "coverage", "matched_words", "first_char", "end_char"])

    return chosen.mapInArrow(run, schema)
