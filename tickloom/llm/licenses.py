"""License texts in documents by patience alignment.

Two word sequences are aligned on the words that are unique in both: of these anchors the longest
increasing run is kept, and the gaps between neighbours are aligned in the same way. Where a gap
has no such word, equal words at its ends are paired. Coverage is the share of a template's
words that found their place.

A template is looked for around every place of the word that is rarest in the document among
its rarest ones, in a stretch somewhat longer than the template; the text before and after an occurrence is searched on, so
a license that stands several times in one text is found each time, copies side by side too. Stretches that cannot reach the coverage, because
too few of the template's words occur in them, are not aligned.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame

from tickloom.llm.common import batches, id_and_text

COVERAGE = 0.8

# Wordings of public licenses and notices.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
        "notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with "
        "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
        "applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
        "governing permissions and limitations under the License."
    ),
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
        "version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
    ),
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "MIT-warranty": (
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
        "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
        "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND "
        "THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND "
        "FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
        "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
        "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "BSD-3-Clause-endorsement": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived "
        "from this software without specific prior written permission."
    ),
    "BSD-warranty": (
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, "
        "BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT "
        "SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL "
        "DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
        "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE "
        "OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "LGPL-3.0": (
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "AGPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
}

WORD = re.compile(r"[^\W_]+(?:[.'][^\W_]+)*")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def longest_run(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest run of pairs, given in the order of their first parts, whose second parts increase."""
    tails: list[int] = []
    heads: list[int] = []
    before: list[int | None] = [None] * len(pairs)
    for i, (_, b) in enumerate(pairs):
        at = bisect_left(tails, b)
        before[i] = heads[at - 1] if at else None
        tails[at : at + 1], heads[at : at + 1] = [b], [i]
    out, i = [], heads[-1] if heads else None
    while i is not None:
        out.append(pairs[i])
        i = before[i]
    return out[::-1]


def patience(left: list[str], right: list[str]) -> list[tuple[int, int]]:
    """Pairs of places of equal words, increasing in both sequences."""
    matched: list[tuple[int, int]] = []
    gaps = [(0, len(left), 0, len(right))]
    while gaps:
        a, b, c, d = gaps.pop()
        while a < b and c < d and left[a] == right[c]:
            matched.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and left[b - 1] == right[d - 1]:
            b, d = b - 1, d - 1
            matched.append((b, d))
        if a >= b or c >= d:
            continue
        ours, theirs = Counter(left[a:b]), Counter(right[c:d])
        place = {w: j for j, w in enumerate(right[c:d], c) if theirs[w] == 1}
        anchors = longest_run([(i, place[w]) for i, w in enumerate(left[a:b], a) if ours[w] == 1 and w in place])
        if not anchors:
            continue
        matched += anchors
        edges = [(a - 1, c - 1), *anchors, (b, d)]
        gaps += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges[:-1], edges[1:])]
    return sorted(matched)


class LicenseSearch:
    def __init__(self, templates: dict[str, str], coverage: float) -> None:
        self.coverage = coverage
        self.templates = {name: words_of(text) for name, text in templates.items() if words_of(text)}
        self.counts = {name: Counter(words) for name, words in self.templates.items()}
        self.users: dict[str, list[str]] = defaultdict(list)
        for name, counts in self.counts.items():
            for word in counts:
                self.users[word].append(name)

    def found(self, text: str) -> list[tuple[str, float, int, int, int]]:
        """(template, coverage, words matched, first word, word after the last) of each occurrence."""
        words = words_of(text)
        places: dict[str, list[int]] = {w: [] for w in set(words) & self.users.keys()}
        if not places:
            return []
        reach: Counter[str] = Counter()
        for word in places:
            for name in self.users[word]:
                reach[name] += self.counts[name][word]
        ready = [n for n, got in reach.items() if got >= self.coverage * len(self.templates[n])]
        if not ready:
            return []
        for i, word in enumerate(words):
            if word in places:
                places[word].append(i)
        return [hit for name in sorted(ready) for hit in self._occurrences(name, words, places)]

    def _occurrences(self, name: str, words: list[str], places: dict[str, list[int]]):
        template, counts = self.templates[name], self.counts[name]
        need = self.coverage * len(template)
        # An occurrence lacks less than this many words, so it holds one of the rarest words that make up more.
        spare, seeds = len(template) - need, []
        for word in sorted(counts, key=lambda w: (len(places.get(w, ())), w)):
            seeds += places.get(word, ())
            spare -= counts[word]
            if spare < 0:
                break
        spots: dict[str, list[int]] = defaultdict(list)
        for at, word in enumerate(template):
            spots[word].append(at)
        margin = len(template) + len(template) // 4 + 2

        def aligned(lo: int, hi: int) -> list[tuple[int, int]] | None:
            part = words[lo:hi]
            inside = Counter(w for w in part if w in counts)
            if sum(min(n, counts[w]) for w, n in inside.items()) < need:
                return None
            # Words far from the rest were paired by chance: only a stretch of the margin's length counts.
            pairs = self._densest(patience(template, part), margin)
            return [(i, lo + j) for i, j in pairs] if len(pairs) >= need else None

        def around(seed: int, low: int, high: int) -> list[tuple[int, int]] | None:
            """The occurrence near a seed: in a wide stretch, or, where neighbouring copies blur that, in one that holds no second copy."""
            lo, hi = max(low, seed - margin), min(high, seed + margin)
            part = Counter(w for w in words[lo:hi] if w in counts)
            if sum(min(n, counts[w]) for w, n in part.items()) < need:
                return None
            slack = len(template) // 8 + 1
            tight = ((max(lo, seed - at - slack), min(hi, seed - at + len(template) + slack)) for at in spots[words[seed]])
            return aligned(lo, hi) or next((pairs for stretch in tight if (pairs := aligned(*stretch))), None)

        # Stretches still to search; what lies before an occurrence is searched again without it.
        order, open_ = sorted(set(seeds)), [(0, len(words))]
        while open_:
            low, high = open_.pop()
            for seed in order[bisect_left(order, low) : bisect_left(order, high)]:
                if seed >= low and (pairs := around(seed, low, high)):
                    first, last = pairs[0][1], pairs[-1][1] + 1
                    yield name, len(pairs) / len(template), len(pairs), first, last
                    open_ += [(last, high), (low, first)]
                    break

    @staticmethod
    def _densest(pairs: list[tuple[int, int]], margin: int) -> list[tuple[int, int]]:
        best, lo = (0, 0), 0
        for hi in range(len(pairs)):
            while pairs[hi][1] - pairs[lo][1] >= margin:
                lo += 1
            if hi + 1 - lo > best[1] - best[0]:
                best = (lo, hi + 1)
        return pairs[best[0] : best[1]]


def license_spans(
    docs: DataFrame, templates: dict[str, str] = TEMPLATES, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, license, coverage, n_matched, first_word, end_word``: a row for each occurrence.

    Words are runs of letters and digits of the whole text in small letters. Null and empty texts
    have none; repeated rows give repeated rows, a null id stays null; templates without words are never found, and an
    empty table gives no rows.
    """
    search: list[LicenseSearch] = []

    def step(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        if not search:
            search.append(LicenseSearch(templates, coverage))
        rows = [
            (doc, *hit)
            for doc, text in zip(batch.column("__id").to_pylist(), batch.column("__text").to_pylist())
            if text
            for hit in search[0].found(text.decode("utf-8", "replace"))
        ]
        if not rows:
            return None
        types = (pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.int32())
        names = ["doc_id", "license", "coverage", "n_matched", "first_word", "end_word"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    schema = "doc_id long, license string, coverage double, n_matched int, first_word int, end_word int"
    return batches(id_and_text(docs, id_col, text_col), step, schema)
