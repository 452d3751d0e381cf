"""License scans: winnowed template fingerprints pick candidates, banded alignment reports coverage and spans."""

from __future__ import annotations

from bisect import bisect
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxspark.llm import textkit
from voxspark.llm.decontaminate import GAP

GRAM, WINNOW = 3, 4
SHORT = 16
#: Diagonals on either side of a fingerprint's, and the share of a template's words by which a match may move.
BAND = 4
STRAY = 0.3
LEAST = 0.8

#: Public licence texts, their notices and short forms of them.
TEMPLATES = {
    "mit": "Released under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "isc-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-2-clause-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "bsd-3-clause-endorsement": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "unlicense-text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "bsl-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "apache-2.0-disclaimer": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-disclaimer": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "lgpl-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "agpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    "epl-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nc-4.0-notice": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "all-rights-reserved": "All rights reserved.",
}

SCHEMA = "doc_id long, template string, coverage double, matched long, template_words long, first_word long, last_word long"
_ONE = 1 << 40


def winnow(value: np.ndarray) -> np.ndarray:
    """Places of the least hash of every WINNOW neighbours, rightmost of equals; of all where they are fewer."""
    n = max(len(value) - WINNOW + 1, 1)
    return np.unique([i + len(w) - 1 - int(np.argmin(w[::-1])) for i in range(n) if len(w := value[i : i + WINNOW])]).astype(np.int64)


def align(want: list[int], have: list[int], low: int, high: int) -> tuple[int, int, int]:
    """(matched, first, last) of the best common subsequence of template and text words on a band of diagonals.

    Cell (i, j) is on the band if j - i is from ``low`` to ``high``. Most words matched win, then the shortest span,
    then the earlier one. A cell's value is its matches, and then where in the text they begin, the later the better.
    """
    width, best = high - low + 1, (0, 0, -1, -1)
    row = [0] * (width + 1)
    for i, word in enumerate(want):
        new = [0] * (width + 1)
        for d in range(width):
            j = i + low + d
            value = row[d + 1]  # the template's word is left out
            if d and new[d - 1] > value:
                value = new[d - 1]  # the text's word is
            if 0 <= j < len(have) and have[j] == word:
                met = row[d] + _ONE if row[d] else _ONE + j
                if met > value:
                    value = met
                n, first = met // _ONE, met % _ONE
                if (n, first - j) > best[:2]:
                    best = (n, first - j, first, j)
            new[d] = value
        row = new
    return best[0], best[2], best[3]


class Templates:
    """Templates' words, and an inverted index from fingerprint to (template, place).

    Fingerprints are winnowed word 3-grams: any six words that a text has in common with a template hold one. Of a
    template of fewer than SHORT words all 2-grams are kept, so that a changed word doesn't hide it.
    """

    def __init__(self, texts: dict[str, str]):
        self.names, self.words, self.index = list(texts), [], defaultdict(list)
        for t in texts.values():
            (s,) = textkit.slices(pa.array([t]))
            w = textkit.words(s, gap=GAP)
            number, short = len(self.words), len(w.hash) < SHORT
            self.words.append(w.hash.tolist())
            k = min(2 if short else GRAM, len(w.hash))
            value, at = textkit.grams(w, k)
            for p in range(len(value)) if short else winnow(value).tolist():
                self.index[k, int(value[p])].append((number, int(at[p])))
        self.sets = [set(w) for w in self.words]
        self.keys = {k: np.array(sorted(v for n, v in self.index if n == k), np.uint64) for k in {n for n, _ in self.index}}

    def find(self, w: textkit.Words) -> Iterator[tuple[int, int, float, int, int, int]]:
        """(row, template, coverage, matched, first word, last word) of each place where enough of a template stands."""
        total = np.concatenate([[0], np.cumsum(np.bincount(w.row, minlength=w.rows))])
        hits: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for k, keys in self.keys.items():
            value, at = textkit.grams(w, k)
            place = np.minimum(np.searchsorted(keys, value), len(keys) - 1)
            for i in np.flatnonzero(keys[place] == value).tolist():
                row = int(w.row[at[i]])
                j = int(at[i] - total[row])
                for template, p in self.index[k, int(value[i])]:
                    hits[row][template].append((j - p, j))
        for row, by_template in hits.items():
            have = w.hash[total[row] : total[row + 1]]
            found = [(n, n / len(self.words[t]), first, last, t) for t, own in by_template.items() for n, first, last in self._places(t, have, own)]
            # Of places that overlap, that with more words stays, then that of the better coverage, then the earlier.
            ends: list[int] = []
            taken: list[tuple] = []
            for place in sorted(found, key=lambda x: (-x[0], -x[1], x[2], x[3], x[4])):
                at = bisect(ends, place[2])
                if (at == len(ends) or taken[at][2] > place[3]) and (not at or ends[at - 1] < place[2]):
                    ends.insert(at, place[3])
                    taken.insert(at, place)
            for n, coverage, first, last, t in taken:
                yield row, t, coverage, n, first, last

    def _places(self, template: int, have: np.ndarray, hits: list[tuple[int, int]]) -> Iterator[tuple[int, int, int]]:
        """Places of one template, from left to right.

        Diagonals of fingerprints that lie within BAND of the one before are one band, as words put in or left out
        move a match from one to the next, up to STRAY of the template's words apart. The best match of a band is
        taken; hits before its end are used up. Where a band has none, its first diagonal is.
        """
        want, known = self.words[template], self.sets[template]
        need, reach = LEAST * len(want), max(BAND, int(STRAY * len(want)))
        hits, at, end = sorted(hits), 0, -1
        while at < len(hits):
            shift = top = hits[at][0]
            if hits[at][1] <= end:
                at += 1
                continue
            to = at
            while to < len(hits) and hits[to][0] <= min(top + BAND, shift + reach):
                top = hits[to][0]
                to += 1
            low, high = shift - BAND, top + BAND
            begin = max(0, low, end + 1)
            window = have[begin : high + len(want)].tolist()
            n, first, last = align(want, window, low - begin, high - begin) if sum(x in known for x in window) >= need else (0, -1, -1)
            if n >= need and last - first < (1 + STRAY) * len(want):
                yield n, begin + first, begin + last
                end = begin + last
            while at < len(hits) and hits[at][0] == shift:
                at += 1


def license_spans(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, template, coverage, matched, template_words, first_word, last_word): each place in a whole text where
    at least 0.8 of a template's words stand in order, in a band around the diagonals of its fingerprints and in at
    most 1.3 times as many words.

    Words are runs of characters other than ASCII blanks and punctuation, A-Z lower-cased. Templates are winnowed;
    all word n-grams of a text probe the inverted index. Repeated notices are a place each. Places of one or several
    templates that overlap leave that with most words matched, of equals the better covered, then the earlier. Null
    and empty texts have no spans; repeated rows give theirs each; an empty table gives no rows; extra columns are
    ignored. The templates are a fixed parameter of some KB; documents aren't shuffled.
    """
    index = docs.sparkSession.sparkContext.broadcast(Templates(templates or TEMPLATES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Templates = index.value
        for b in batches:
            for t in textkit.slices(b.column("text")):
                got = list(m.find(textkit.words(t, gap=GAP)))
                if got:
                    row, template, coverage, n, first, last = zip(*got, strict=True)
                    ids = b.column("doc_id").take(pa.array(np.array(row) + t.first))
                    sizes = [len(m.words[i]) for i in template]
                    yield pa.RecordBatch.from_arrays([ids, pa.array([m.names[i] for i in template]), pa.array(coverage), *(pa.array(x, pa.int64()) for x in (n, sizes, first, last))], ["doc_id", "template", "coverage", "matched", "template_words", "first_word", "last_word"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
