"""License scans by patience alignment.

Where a stretch of a text holds enough of a template's words in their order, the two are aligned: words that occur once in
both are anchors, the longest increasing run of them is kept, and the gaps between are aligned in the same way. Coverage is
the share of the template's words that are matched. A stretch may hold as many foreign words as three templates, SPREAD at
most, wherever they stand. Stretches are found by the length of the longest common subsequence, bit-parallel: the first
place where it reaches the least coverage, and from there back to the last place where such a stretch may begin.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import raw_texts

LEAST, SPREAD = 0.8, 256

#: The wording of public licenses, notices and usual one-line statements.
TEMPLATES = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "MIT (warranty)": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "BSD-3-Clause (third clause)": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSD (warranty)": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "LGPL-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution.",
    "MIT (line)": "Released under the MIT License.",
    "Apache-2.0 (line)": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0 (line)": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0 (line)": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0 (line)": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
}
_WORD = re.compile(rb"[a-z0-9\x80-\xff]+")


def words_of(text: bytes) -> list[bytes]:
    return _WORD.findall(text.lower())


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence, of pairs in the order of their first numbers, whose second numbers rise: by piles of cards."""
    tops: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for i, (_, y) in enumerate(pairs):
        k = bisect_left(tops, y)
        back.append(at[k - 1] if k else -1)
        if k == len(tops):
            tops.append(y)
            at.append(i)
        else:
            tops[k], at[k] = y, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def _rows(x: list[bytes], y: list[bytes]) -> list[int]:
    """The length of the longest common subsequence of x with each beginning of y."""
    row = [0] * (len(y) + 1)
    for w in x:
        was = 0
        for j, v in enumerate(y, 1):
            was, row[j] = row[j], was + 1 if v == w else row[j] if row[j] >= row[j - 1] else row[j - 1]
    return row


def _common(a: list[bytes], b: list[bytes], a0: int, b0: int) -> list[tuple[int, int]]:
    """Where no word is unique: a longest common subsequence, in memory that grows with the length of b alone (halves of a go
    to where their subsequences together are longest)."""
    if not a or not b:
        return []
    if len(a) == 1:
        return [(a0, b0 + b.index(a[0]))] if a[0] in b else []
    h = len(a) // 2
    left, right = _rows(a[:h], b), _rows(a[h:][::-1], b[::-1])[::-1]
    k = max(range(len(b) + 1), key=lambda j: left[j] + right[j])
    return _common(a[:h], b[:k], a0, b0) + _common(a[h:], b[k:], a0 + h, b0 + k)


def align(a: list[bytes], b: list[bytes], a0: int = 0, b0: int = 0) -> list[tuple[int, int]]:
    """Matched positions of a and b."""
    if not a or not b:
        return []
    na, nb = Counter(a), Counter(b)
    place = {w: j for j, w in enumerate(b) if nb[w] == 1}
    anchors = _rising([(i, place[w]) for i, w in enumerate(a) if na[w] == 1 and w in place])
    if not anchors:
        return _common(a, b, a0, b0)
    out, i0, j0 = [], 0, 0
    for i, j in [*anchors, (len(a), len(b))]:
        out += align(a[i0:i], b[j0:j], a0 + i0, b0 + j0)
        if i < len(a):
            out.append((a0 + i, b0 + j))
        i0, j0 = i + 1, j + 1
    return out


def _reach(words: Iterator[bytes], places: dict[bytes, int], full: int, least: int) -> Iterator[tuple[int, int]]:
    """How long the common subsequence with a template is after each word, from where it is least. places: bits of a word's places."""
    v, most = full, 0
    for i, w in enumerate(words):
        if (m := places.get(w)) is not None:
            u = v & m
            v = ((v + u) | (v - u)) & full
            n = full.bit_length() - v.bit_count()
            if n > most:
                most = n
                if n >= least:
                    yield i, n


class Scanner:
    def __init__(self, templates: dict[str, str], least: float = LEAST, spread: int = SPREAD):
        self.templates = [(name, words_of(t.encode())) for name, t in templates.items()]
        self.need = [max(1, -int(-least * len(t) // 1)) for _, t in self.templates]
        self.wide = [len(t) + min(spread, 3 * len(t)) for _, t in self.templates]
        self.kinds = [Counter(t) for _, t in self.templates]
        self.places, self.back = [], []
        for _, t in self.templates:
            for to, words in ((self.places, t), (self.back, t[::-1])):
                bits: dict[bytes, int] = {}
                for k, w in enumerate(words):
                    bits[w] = bits.get(w, 0) | 1 << k
                to.append(bits)
        self.holders: dict[bytes, list[int]] = {}
        for k, kinds in enumerate(self.kinds):
            for w in kinds:
                self.holders.setdefault(w, []).append(k)

    def _starts(self, k: int, words: list[bytes], at: list[int]) -> Iterator[int]:
        """Hits from which a stretch holds enough of the template's words, each as often as it stands there, in any order."""
        kinds, need, wide = self.kinds[k], self.need[k], self.wide[k]
        held, good, e = Counter(), 0, 0
        for s in at:
            while e < len(at) and at[e] < s + wide:
                w = words[at[e]]
                held[w] += 1
                good += held[w] <= kinds[w]
                e += 1
            if good >= need:
                yield s
            w = words[s]
            good -= held[w] <= kinds[w]
            held[w] -= 1

    def __call__(self, text: bytes) -> list[tuple[str, float, int, int, int]]:
        """License, coverage, places, first and last word, of each template covered well enough; the best place counts."""
        words = words_of(text)
        hits: list[list[int]] = [[] for _ in self.templates]
        get = self.holders.get
        for i, w in enumerate(words):
            if (held := get(w)) is not None:
                for k in held:
                    hits[k].append(i)
        found = []
        for k, ((name, template), at) in enumerate(zip(self.templates, hits)):
            if len(at) < self.need[k]:
                continue
            best, places, free, full = None, 0, 0, (1 << len(template)) - 1
            for s in self._starts(k, words, at):
                if s < free:
                    continue
                e = next(_reach(words[s : s + self.wide[k]], self.places[k], full, self.need[k]), None)
                if e is None:
                    continue
                e = s + e[0]
                # The last beginning of a stretch that ends here; from it as far as the subsequence grows, before the next copy is full.
                s = e - next(_reach(words[s : e + 1][::-1], self.back[k], full, self.need[k]))[0]
                start = max(free, e - self.wide[k] + 1)
                more = [i for i, _ in _reach(words[start : e + 1][::-1], self.back[k], full, self.need[k])]
                s = min(s, e - more[-1])
                ends = [i for i, _ in _reach(words[s : s + self.wide[k]], self.places[k], full, self.need[k])]
                b = s + ends[-1] + 1
                pairs = align(words[s:b], template, s)
                if len(pairs) < self.need[k]:
                    pairs = _common(words[s:b], template, s, 0)
                places, free = places + 1, b
                if best is None or len(pairs) > best[0]:
                    own = [p[0] for p in pairs]
                    best = len(pairs), min(own), max(own)
            if best:
                found.append((name, best[0] / len(template), places, best[1], best[2]))
        return found


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST) -> DataFrame:
    """One row per row of docs: doc_id, license (of the best coverage, longer templates first, or null), coverage (0 if
    none), places (copies, one after the other), first_word, last_word (of the best), licenses (all that are covered, by name).

    Words are ASCII letters and digits, lower-cased, and bytes of other letters. Null and empty texts hold no license.
    Null doc_ids and repeated rows return; an empty table gives no rows; other columns are ignored.
    """
    templates = TEMPLATES if templates is None else templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = Scanner(templates, least)
        size = {name: len(t) for name, t in scan.templates}
        for batch in batches:
            rows = []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = scan(t.as_py())
                top = max(found, key=lambda f: (f[1], size[f[0]]), default=(None, 0.0, 0, None, None))
                rows.append((i, *top, sorted(f[0] for f in found)))
            kinds = (pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.string()))
            cols = zip(*rows) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=["doc_id", "license", "coverage", "places", "first_word", "last_word", "licenses"])

    return raw_texts(docs).mapInArrow(run, "doc_id long, license string, coverage double, places int, first_word int, last_word int, licenses array<string>")
