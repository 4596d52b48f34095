"""License scans by patience alignment of texts with license templates.

Words that are unique in both a stretch of text and a template are anchors; their longest increasing subsequence is kept, and
the gaps between anchors are aligned in the same way. Coverage is the share of the template's words that are aligned.

For each template there is a set of rare words, at least one of which is in any stretch that covers enough of it; one Aho-Corasick
automaton finds them all in a single pass, and only around them is anything aligned. Each window around them that has enough words of the
template, and begins and ends with words that may be aligned, is a candidate; overlaps are resolved after verification. So each stretch that is
covered when aligned by itself, from its first word to its last, is found, or one that overlaps it.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

#: Least coverage of a template, and least share of aligned words within the stretch of text.
COVERAGE, DENSITY = 0.8, 0.5
SCHEMA = "doc_id long, license string, coverage double, n_matched int, n_words int, start_char int, end_char int"
WORD = re.compile(r"[^\W_]+")
#: Words too frequent in any text to look for.
COMMON = frozenset("the of and to in is for a an or as by with this that be are from on not any all you your it may if under at no shall will such".split())

_CC = {"BY": "Attribution", "BY-SA": "Attribution ShareAlike", "BY-NC": "Attribution NonCommercial", "BY-ND": "Attribution NoDerivatives", "BY-NC-SA": "Attribution NonCommercial ShareAlike", "BY-NC-ND": "Attribution NonCommercial NoDerivatives"}
#: (license, text); a license may have several.
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and limitations under the License."""),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software
without specific prior written permission."""),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY
DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF
USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING
NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the
use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If
you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly
marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."""),
    ("Unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this
software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""),
    ("BSL-1.0", """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this
license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit
third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including
the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works
of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""),
    ("ISC", "Licensed under the ISC License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free
Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file,
You can obtain one at http://mozilla.org/MPL/2.0/."""),
    ("All rights reserved", "All rights reserved."),
    *((f"CC-{k}-4.0", f"Licensed under CC {k} 4.0.") for k in _CC),
    *((f"CC-{k}-4.0", f"This work is licensed under a Creative Commons {v} 4.0 International License.") for k, v in _CC.items()),
]


def words_of(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """Lower-cased runs of letters and digits, and where each begins and ends."""
    at = [m.span() for m in WORD.finditer(text)]
    return [text[a:b].lower() for a, b in at], at


def patience(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Aligned positions (i, j) with a[i] == b[j], increasing in both.

    Common beginnings and ends are aligned, then words that occur once in either; the gaps between them likewise, until
    a gap has no such word.
    """
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, x, j, y = todo.pop()
        while i < x and j < y and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < x and j < y and a[x - 1] == b[y - 1]:
            x, y = x - 1, y - 1
            out.append((x, y))
        if i >= x or j >= y:
            continue
        once = {w for w, n in Counter(b[j:y]).items() if n == 1}
        once &= {w for w, n in Counter(a[i:x]).items() if n == 1}
        if not once:
            continue
        where = {w: k for k, w in enumerate(a[i:x], i) if w in once}
        pairs = [(where[w], k) for k, w in enumerate(b[j:y], j) if w in once]
        for p, q in _longest_increasing(pairs):
            todo.append((i, p, j, q))
            out.append((p, q))
            i, j = p + 1, q + 1
        todo.append((i, x, j, y))
    return sorted(out)


def _longest_increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of pairs that increase in the second place, the longest subsequence that increases in the first too, by patience sorting."""
    piles: list[int] = []
    last: list[int] = []
    before = [-1] * len(pairs)
    for k, (p, _) in enumerate(pairs):
        at = bisect_left(piles, p)
        before[k] = last[at - 1] if at else -1
        if at == len(piles):
            piles.append(p)
            last.append(k)
        else:
            piles[at], last[at] = p, k
    out, k = [], last[-1] if last else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def _rank(aligned: int, width: int) -> int:
    """By which stretches of one template are chosen: words at an end that stand apart by more than twice as many others don't pay, as in _compact()."""
    return 3 * aligned - width


def _apart(found: list[tuple]) -> list[tuple]:
    """Of (.., start, end) in order of preference, those that overlap none before them."""
    taken: list[tuple] = []
    for f in found:
        at = bisect_left(taken, f[3], key=lambda g: g[3])
        if (at == 0 or taken[at - 1][4] <= f[3]) and (at == len(taken) or taken[at][3] >= f[4]):
            taken.insert(at, f)
    return taken


class Scanner:
    """The templates, and the words by which stretches that cover one of them are found."""

    def __init__(self, templates: list[tuple[str, str]], coverage: float = COVERAGE):
        self.coverage = coverage
        self.names = [n for n, _ in templates]
        self.words = [words_of(t)[0] for _, t in templates]
        self.counts = [Counter(w) for w in self.words]
        keys: dict[str, list[int]] = {}
        spread = Counter(w for own in self.words for w in set(own))
        for k, own in enumerate(self.words):
            need, held = len(own) - math.ceil(coverage * len(own) - 1e-9), 0
            for w in sorted(set(own), key=lambda w: (w in COMMON, len(w) < 3, spread[w] if len(w) > 2 else 0, w.isdigit(), -len(w), w)):
                if held > need:
                    break
                keys.setdefault(w, []).append(k)
                held += self.counts[k][w]
        self.keys = keys
        self.machine = ahocorasick.Automaton()
        for w in keys:
            self.machine.add_word(w, w)
        self.machine.make_automaton()

    def scan(self, text: str) -> list[tuple[str, float, int, int, int, int]]:
        """(license, coverage, aligned words, template's words, start, end) of stretches that cover a template, none overlapping.

        Of stretches that overlap the one with the most aligned words stays, then the one with more coverage.
        """
        low = text.lower()
        if len(low) != len(text):
            low = "".join(c.lower()[0] for c in text)
        hit: set[int] = set()
        for end, w in self.machine.iter(low):
            start = end - len(w) + 1
            if (start == 0 or not (low[start - 1].isalnum())) and (end + 1 == len(low) or not low[end + 1].isalnum()):
                hit.update(self.keys[w])
        if not hit:
            return []
        own, at = words_of(text)
        places: dict[int, list[int]] = {k: [] for k in hit}
        for i, w in enumerate(own):
            for k in self.keys.get(w, ()):
                if k in places:
                    places[k].append(i)
        found = []
        for k in sorted(hit):
            for a, b in self._regions(len(own), places[k], k):
                found += self._covering(own, a, b, k)
        found.sort(key=lambda f: (-f[1], -f[0], f[3], f[2]))
        return sorted(((self.names[k], c, m, len(self.words[k]), at[a][0], at[b - 1][1]) for c, m, k, a, b in _apart(found)), key=lambda r: r[4])

    def _regions(self, n_own: int, hits: list[int], k: int) -> list[tuple[int, int]]:
        """Words that may lie in a stretch with one of the hits, which has n / DENSITY words at most; regions that meet are one."""
        reach = int(len(self.words[k]) / DENSITY)
        out: list[list[int]] = []
        for i in hits:
            low, high = max(0, i - reach + 1), min(n_own, i + reach)
            if out and low <= out[-1][1]:
                out[-1][1] = high
            else:
                out.append([low, high])
        return [(a, b) for a, b in out]

    def _windows(self, own: list[str], low: int, high: int, k: int) -> list[tuple[int, int, int]]:
        """(rank at most, start, end) of all windows of a region that may be a stretch.

        Such a window has n / DENSITY words at most and a common subsequence with the template that covers it, and begins and ends with words
        that are aligned: at most n - least of the template's words lie before the first one and behind the last one.
        """
        words, counts = self.words[k], self.counts[k]
        n = len(words)
        least, reach = max(1, math.ceil(self.coverage * n - 1e-9)), int(n / DENSITY)
        spots = [i for i in range(low, high) if own[i] in counts]
        if len(spots) < least:
            return []
        first, last, bits = set(words[: n - least + 1]), set(words[least - 1 :]), dict.fromkeys(counts, 0)
        for j, w in enumerate(words):
            bits[w] |= 1 << j
        # words that the widest window at each spot shares with the template in any order, by sliding it
        held: Counter = Counter()
        out, shared, right = [], 0, 0
        for left, a in enumerate(spots):
            while right < len(spots) and spots[right] < a + reach:
                w = own[spots[right]]
                held[w] += 1
                shared += held[w] <= counts[w]
                right += 1
            if shared >= least and own[a] in first:
                # longest common subsequence with each window from here on, bit-parallel: the zeros of `row`
                full = row = (1 << n) - 1
                for i in spots[left:right]:
                    hit = row & bits[own[i]]
                    row = (row + hit | row - hit) & full
                    common = n - row.bit_count()
                    if common >= least and own[i] in last and common >= DENSITY * (i + 1 - a):
                        out.append((_rank(common, i + 1 - a), a, i + 1))
            w = own[a]
            shared -= held[w] <= counts[w]
            held[w] -= 1
        return out

    def _covering(self, own: list[str], low: int, high: int, k: int) -> list[tuple[float, int, int, int, int]]:
        """(coverage, aligned words, template, start, end) of the stretches of a region that cover a template, none overlapping.

        A window that meets a stretch whose rank it can't exceed isn't aligned.
        """
        n, found, near = len(self.words[k]), [], {}
        reach = int(n / DENSITY)
        for most, a, b in sorted(self._windows(own, low, high, k), key=lambda w: (-w[0], w[1], w[2])):
            if any(r >= most and a < y and x < b for c in range(a // reach - 1, (b - 1) // reach + 1) for r, x, y in near.get(c, ())):
                continue
            pairs = self._compact(patience(own[a:b], self.words[k]))
            if pairs and len(pairs) >= self.coverage * n - 1e-9 and len(pairs) >= DENSITY * (pairs[-1][0] - pairs[0][0] + 1):
                x, y = a + pairs[0][0], a + pairs[-1][0] + 1
                near.setdefault(x // reach, []).append((_rank(len(pairs), y - x), x, y))
                found.append((len(pairs) / n, len(pairs), k, x, y))
        return _apart(sorted(found, key=lambda f: (-_rank(f[1], f[4] - f[3]), f[3])))

    @staticmethod
    def _compact(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """Without aligned words at either end that stand apart from the rest by more words than they are."""
        while len(pairs) > 1:
            cut = next((k for k in range(1, len(pairs) // 2 + 1) if pairs[k][0] - pairs[k - 1][0] - 1 > max(2, 2 * k)), 0)
            if cut:
                pairs = pairs[cut:]
                continue
            cut = next((k for k in range(1, len(pairs) // 2 + 1) if pairs[-k][0] - pairs[-k - 1][0] - 1 > max(2, 2 * k)), 0)
            if not cut:
                break
            pairs = pairs[:-cut]
        return pairs


_scanners: dict[int, Scanner] = {}


def _scan_batches(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates, coverage = sent.value
        key = hash((tuple(templates), coverage))
        if key not in _scanners:
            _scanners.clear()
            _scanners[key] = Scanner(templates, coverage)
        scanner = _scanners[key]
        kinds = (pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
        names = ["doc_id", "license", "coverage", "n_matched", "n_words", "start_char", "end_char"]
        for batch in batches:
            rows = [(d, *r) for d, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for r in scanner.scan(text)] if scanner.keys else []
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 7, kinds)], names=names)

    return run


def license_scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, coverage: float = COVERAGE) -> DataFrame:
    """Each stretch of text that covers a license template: (doc_id, license, coverage, n_matched, n_words, start_char, end_char).

    coverage is n_matched of the template's n_words. Positions are characters, the end exclusive. Case, punctuation and
    spacing don't matter. A license that occurs several times in a text is reported each time.

    Null and empty texts have none; a null id is reported as null. Repeated rows report as often as they occur. Texts of any length are read
    whole. Other columns are ignored. An empty table or no templates give an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(([tuple(t) for t in templates], coverage))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text <> ''")
    return docs.mapInArrow(_scan_batches(sent), SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents", "doc_id", "text"))
