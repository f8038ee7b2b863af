"""License scans by patience alignment.

A text's words and a template's are aligned: equal ends first, then words that
occur once in both, of which the longest increasing subsequence is kept as
anchors, then the gaps between anchors in the same way.  Coverage is the share
of the template's words that are aligned.  Only places that can reach
MIN_COVERAGE are aligned: those with enough of a template's words.
"""

from __future__ import annotations

from bisect import bisect_left
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressmill.llm.text import Words, map_texts

MIN_COVERAGE = 0.8

_WARRANTY = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. """
_GNU = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0}General Public License as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0}General Public License for more details."""

#: Whole texts of short licenses, the headers that longer ones (Apache, GNU, Mozilla) ask to be put in files, one-line notices, and that of reserved rights.
TEMPLATES = {
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0 header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "MIT notice": "Released under the MIT License",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3",
    "GPL header": _GNU.format("", "3"),
    "LGPL header": _GNU.format("Lesser ", "3"),
    "AGPL header": _GNU.format("Affero ", "3"),
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0 notice": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-SA-4.0 notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "CC-BY-NC-SA-4.0 notice": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License",
    "CC0-1.0 notice": "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.",
    "BSD-2-Clause": _BSD + _WARRANTY,
    "BSD-3-Clause": _BSD + "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _WARRANTY,
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution.""",
    "BSL-1.0": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.""",
    "MPL-2.0 notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "MPL-2.0 header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "rights reserved notice": "All rights reserved",
}


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Pairs of positions, increasing in both, at which a and b are aligned."""
    out: list[tuple[int, int]] = []
    work = [(0, len(a), 0, len(b))]
    while work:
        i, j, k, m = work.pop()
        while i < j and k < m and a[i] == b[k]:
            out.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            out.append((j, m))
        if i >= j or k >= m:
            continue
        left, right = _once(a, i, j), _once(b, k, m)
        common = sorted((p, right[x]) for x, p in left.items() if x in right)
        last: list[int] = []  # the least end of an increasing run of each length
        tops: list[int] = []
        before: list[int] = []
        for n, (_, q) in enumerate(common):
            at = bisect_left(last, q)
            before.append(tops[at - 1] if at else -1)
            last[at : at + 1], tops[at : at + 1] = [q], [n]
        anchors, n = [], tops[-1] if tops else -1
        while n >= 0:
            anchors.append(common[n])
            n = before[n]
        if not anchors:
            continue
        anchors.reverse()
        out += anchors
        for (p, q), (r, s) in zip([(i - 1, k - 1), *anchors], [*anchors, (j, m)], strict=True):
            work.append((p + 1, r, q + 1, s))
    return sorted(out)


def _once(x: list[int], i: int, j: int) -> dict[int, int]:
    seen: dict[int, int] = {}
    for p in range(i, j):
        seen[x[p]] = -1 if x[p] in seen else p
    return {w: p for w, p in seen.items() if p >= 0}


@lru_cache(4)
def _compiled(items: tuple[tuple[str, str], ...]):
    names = [n for n, _ in items]
    words = [Words([t]).hash for _, t in items]
    vocabulary = np.unique(np.concatenate(words)) if words else np.zeros(0, np.uint64)
    member = np.zeros((len(vocabulary), len(items)), np.float32)
    for k, w in enumerate(words):
        member[np.searchsorted(vocabulary, w), k] = 1
    lacking = np.array([int(len(w) * (1 - MIN_COVERAGE)) for w in words])
    return names, [np.searchsorted(vocabulary, w).tolist() for w in words], vocabulary, member, member.sum(0) - lacking


def matches(texts: list[str], items: tuple[tuple[str, str], ...]) -> list[tuple[int, str, float, int, int]]:
    """Text, license, coverage, begin and end (characters) of each notice found.

    Within a text the places of one template don't overlap.  Windows of 1.5 times the template's length that hold enough of its words are gone through once,
    from left to right: of the next ones that overlap the one with most of its words is aligned, and if that doesn't do the first of them.
    """
    names, templates, vocabulary, member, need = _compiled(items)
    w = Words(texts)
    if not len(w.hash) or not len(vocabulary):
        return []
    at = np.minimum(np.searchsorted(vocabulary, w.hash), len(vocabulary) - 1)
    at = np.where(vocabulary[at] == w.hash, at, -1)
    hit = np.flatnonzero(at >= 0)
    present = np.zeros((len(texts), len(vocabulary)), np.float32)
    present[w.owner()[hit], at[hit]] = 1
    out = []
    for i, k in zip(*np.nonzero(present @ member >= need), strict=True):
        lo, hi = w.bounds[i], w.bounds[i + 1]
        template = templates[k]
        wide = len(template) + max(2, len(template) // 2)
        own = np.append(at[lo:hi], np.full(wide, -1))  # so that a window may begin anywhere
        mark = np.where(own >= 0, member[own, k], 0).astype(np.int64)
        least = len(template) - int(len(template) * (1 - MIN_COVERAGE))
        total = np.append(0, np.cumsum(mark))
        inside = total[wide:] - total[:-wide]
        windows, s = np.flatnonzero(inside >= least), 0
        while (n := int(np.searchsorted(windows, s))) < len(windows):
            s = int(windows[n])
            for best in dict.fromkeys((s + int(inside[s : s + wide].argmax()), s)):
                pairs = patience(np.where(mark[best : best + wide] > 0, own[best : best + wide], -1 - np.arange(wide)).tolist(), template)
                coverage = len(pairs) / len(template)
                if coverage >= MIN_COVERAGE:
                    break
            else:
                # A notice leaves a quarter of its window to spare, so that with these steps none is passed over.
                s += max(1, wide // 8)
                continue
            first, last = best + pairs[0][0], best + pairs[-1][0]
            out.append((int(i), names[k], round(coverage, 6), int(w.begin[lo + first] - w.starts[i]), int(w.end[lo + last] - w.starts[i])))
            s = last + 1
    return out


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """doc_id, license, coverage, begin and end (characters of the text) of each notice found in whole texts.

    Null and empty texts have none; equal rows give the same places each; of two templates at one place both come out; templates without words are never
    found; no rows give none.  A text may be of any length: the work is in proportion to it.
    """
    items = tuple(sorted((n, t) for n, t in templates.items() if Words([t]).hash.size))

    def run(texts, part):
        found = matches(texts, items)
        if found:
            i, name, coverage, begin, end = zip(*found, strict=True)
            yield {"doc_id": part.column("doc_id").take(pa.array(i)), "license": list(name), "coverage": list(coverage), "begin": list(begin), "end": list(end)}

    return map_texts(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), run, "doc_id bigint, license string, coverage double, begin int, end int")
