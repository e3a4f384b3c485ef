"""License scans by patience alignment of texts with license templates.

Anchors are words that occur once in both sequences; the longest run of anchors rising in both
is kept, and the gaps before, between and after its anchors are aligned the same way, their
equal ends first.  A template's coverage is the share of its words that are aligned.

Alignment only concerns words that a template has, so a text is reduced to those first, with
their word numbers: one vectorised pass finds them, and texts without enough different words
of a template, standing near enough together, are never aligned.  A gap reaches at most
``SLACK`` times the template's length from the anchors, as a notice stands in one place.  Copies
that follow each other leave few words unique, so parts of about one copy are aligned as well.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels
from .kernels import ALNUM, Words

COVERAGE = 0.8
SLACK = 2

#: The text that the short permissive licenses share, whole license texts, notices of the others.
_MIT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in '
    "the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
    "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
)
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_2 = (
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
    "materials provided with the distribution."
)
_BSD_3 = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific "
    "prior written permission."
)
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES '
    "OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, "
    "INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR "
    "BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY "
    "WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
TEMPLATES: dict[str, str] = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of '
        'the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is '
        'distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing '
        "permissions and limitations under the License."
    ),
    "MIT": "Released under the MIT License.",
    "MIT-opening": _MIT,
    "MIT-text": (
        f"{_MIT} The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A '
        "PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION "
        "OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "BSD-opening": _BSD,
    "BSD-2-Clause-text": f"{_BSD} {_BSD_2} {_BSD_END}",
    "BSD-3-Clause-text": f"{_BSD} {_BSD_2} {_BSD_3} {_BSD_END}",
    "ISC-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and "
        'this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL '
        "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
        "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH "
        "THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "Zlib-text": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this "
        "software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject "
        "to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this "
        "software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as "
        "such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
    ),
    "Unlicense-text": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, "
        "either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software "
        "Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "LGPL-3.0-header": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software "
        "Foundation; either version 3 of the License, or (at your option) any later version."
    ),
    "MPL-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at "
        "https://mozilla.org/MPL/2.0/."
    ),
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "Released into the public domain under CC0 1.0.",
    "all-rights-reserved": "All rights reserved.",
}


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence rising in the second place, of pairs rising in the first (patience piles)."""
    tops: list[int] = []
    ends: list[int] = []
    back: list[int] = []
    for i, (_, b) in enumerate(pairs):
        pile = bisect_left(tops, b)
        back.append(ends[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(b)
            ends.append(i)
        else:
            tops[pile], ends[pile] = b, i
    out = []
    i = ends[-1] if ends else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def align(a: list, b: list) -> list[tuple[int, int]]:
    """Patience alignment: pairs of equal elements, rising in both; ``a`` and ``b`` hold hashable elements."""
    found: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            found.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            found.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        at = {x: j for j, x in enumerate(b[b0:b1], b0) if in_b[x] == 1}
        anchors = _rising([(i, at[x]) for i, x in enumerate(a[a0:a1], a0) if in_a[x] == 1 and x in at])
        if anchors:
            found += anchors
            edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
            todo += [(p + 1, r, q + 1, s) for (p, q), (r, s) in zip(edges, edges[1:], strict=False)]
    return sorted(found)


class Library:
    """Templates as word hashes, with the union of their words."""

    def __init__(self, templates: dict[str, str], coverage: float):
        self.names = list(templates)
        words = Words(pa.array(list(templates.values()), pa.string()), ALNUM, lower=True)
        self.words = [words.hash[a:b].tolist() for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
        self.vocabulary = np.unique(words.hash)
        self.coverage = coverage
        self.member = np.stack([np.isin(self.vocabulary, np.array(w, np.uint64)) for w in self.words]) if self.words else np.zeros((0, 0), bool)

    def scan(self, at: np.ndarray, term: np.ndarray) -> list[tuple[str, float, int, int, int]]:
        """(template, coverage, aligned words, first, last word) of templates found at least as far as asked.

        ``at``: word numbers of the text's words that are in the vocabulary; ``term``: which.
        """
        out = []
        present = np.zeros(len(self.vocabulary), bool)
        present[term] = True
        for k, words in enumerate(self.words):
            need = self.coverage * len(words)
            distinct = self.member[k].sum()
            if (present & self.member[k]).sum() < distinct - (len(words) - need):
                continue
            mine = self.member[k][term]
            best = self._place(at[mine], self.vocabulary[term[mine]], words)
            if best and best[0] >= need:
                out.append((self.names[k], best[0] / len(words), *best))
        return out

    def _place(self, at: np.ndarray, hashes: np.ndarray, words: list[int]) -> tuple[int, int, int] | None:
        """The best alignment of one template: aligned words, first, last word.

        Candidates are the stretches of ``SLACK`` template lengths around the template's rarest
        words in the text, so a notice is found wherever it stands; where one may hold several
        copies, also the stretches of one template length that give the rare word its place.
        """
        reach = SLACK * len(words)
        rare = Counter(hashes.tolist())
        # most-common words place nothing: the rarest word that must be there does
        spare = len(words) - int(np.ceil(self.coverage * len(words)))
        keys = sorted((w for w in dict.fromkeys(words) if w in rare), key=lambda w: rare[w])[: spare + 1]
        centres = np.flatnonzero(np.isin(hashes, np.array(keys, np.uint64)))
        places = {w: [q for q, x in enumerate(words) if x == w] for w in keys}
        fewest = len(set(words)) - spare
        best = None
        last = -1
        for i in centres.tolist():
            c = int(at[i])
            lo, hi = np.searchsorted(at, [c - reach, c + reach + 1])
            if hi <= last:
                continue
            stretches = [(lo, hi)]
            if hi - lo > len(words):
                spans = [(c - q - m, c - q + len(words) + m) for m in sorted({0, spare, len(words) // 2}) for q in places[int(hashes[i])]]
                stretches += [tuple(np.searchsorted(at, x)) for x in spans]
            for a, b in stretches:
                part = hashes[a:b].tolist()
                if len(set(part)) < fewest:
                    continue
                pairs = align(part, words)
                if pairs and (best is None or len(pairs) > best[0]):
                    best = len(pairs), int(at[a + pairs[0][0]]), int(at[a + pairs[-1][0]])
                    if best[0] == len(words):
                        return best
            last = hi if hi - lo <= len(words) else -1
        return best


FOUND = "array<struct<license:string,coverage:double,n_aligned:bigint,start:bigint,stop:bigint>>"


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, licenses (all templates covered, best first), license, coverage, n_aligned, start, stop of the best.

    Words are runs of letters, digits and non-ASCII characters, without regard to ASCII case;
    start and stop are word numbers, stop exclusive.  The best is the one with most aligned
    words, then coverage, then name.  Null and empty texts have none: an empty list and nulls;
    repeated rows give equal results; an empty table gives an empty result; other columns are
    ignored; very long texts are scanned whole.
    """
    library = Library(TEMPLATES if templates is None else templates, coverage)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in kernels.chunks(batch, "text"):
                words = Words(part.column(1), ALNUM, lower=True)
                vocabulary = library.vocabulary
                near = np.minimum(np.searchsorted(vocabulary, words.hash), max(len(vocabulary) - 1, 0))
                known = np.flatnonzero(vocabulary[near] == words.hash) if len(vocabulary) else np.zeros(0, np.int64)
                ends = np.searchsorted(known, words.first)
                rows = []
                for i, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
                    found = library.scan(known[a:b] - words.first[i], near[known[a:b]]) if b > a else []
                    found.sort(key=lambda x: (-x[2], -x[1], x[0]))
                    rows.append([{"license": n, "coverage": c, "n_aligned": k, "start": s, "stop": e + 1} for n, c, k, s, e in found])
                kind = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("n_aligned", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())]))
                yield pa.record_batch([part.column(0), pa.array(rows, kind)], names=["doc_id", "licenses"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    found = rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, licenses {FOUND}")
    best = F.get("licenses", F.lit(0))
    return found.select("doc_id", "licenses", *[best[c].alias(c) for c in ("license", "coverage", "n_aligned", "start", "stop")])
