"""License texts and notices in documents, by patience alignment.

Texts and templates are compared by their words (letters and digits, lower
case).  A stretch of text is a candidate for a template if it holds enough
of the template's words close together; it is then aligned: words that
occur once in both are anchors, the longest increasing run of anchors is
kept, and the gaps between anchors are aligned in the same way, after
equal words at their ends are matched.  Coverage is the share of the
template's words matched.  In short notices the words that name the license
(and its version) must stand in the text in one piece; coverage counts the
words before them.

Of findings that overlap in a text the one with the most matched words stays.
"""

from __future__ import annotations

from bisect import bisect, bisect_left

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cirro.llm.textops import Rolling, text_chunks, words

# License notices and texts.  The words after a bar name the license.
TEMPLATES = {
    "Apache-2.0 notice": "Licensed under the |Apache License, Version 2.0",
    "MIT notice": "Released under the |MIT License",
    "BSD notice": "Released under the |BSD License",
    "BSD-2-Clause notice": "Released under the |BSD 2-Clause License",
    "BSD-3-Clause notice": "Released under the |BSD 3-Clause License",
    "ISC notice": "Released under the |ISC License",
    "GPL-3.0 notice": "This work is licensed under the |GNU General Public License, version 3",
    "GPL-2.0 notice": "This work is licensed under the |GNU General Public License, version 2",
    "LGPL-3.0 notice": "This work is licensed under the |GNU Lesser General Public License, version 3",
    "LGPL-2.1 notice": "This work is licensed under the |GNU Lesser General Public License, version 2.1",
    "AGPL-3.0 notice": "This work is licensed under the |GNU Affero General Public License, version 3",
    "MPL-2.0 notice": "Licensed under the |Mozilla Public License, Version 2.0",
    "EPL-1.0 notice": "Licensed under the |Eclipse Public License, Version 1.0",
    "EPL-2.0 notice": "Licensed under the |Eclipse Public License, Version 2.0",
    "Unlicense notice": "Released under the |Unlicense",
    "CC0-1.0 notice": "Licensed under |CC0 1.0",
    **{f"CC-{kind}-{version} notice": f"Licensed under |CC {kind} {version}"
       for kind in ("BY", "BY-SA", "BY-NC", "BY-NC-SA", "BY-ND", "BY-NC-ND") for version in ("2.0", "2.5", "3.0", "4.0")},
    "Reserved notice": "|All rights reserved",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
        this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED
        "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
        MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
        HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
        ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "BSD": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this
        list of conditions and the following disclaimer in the documentation and/or other materials provided with the
        distribution.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this
        list of conditions and the following disclaimer in the documentation and/or other materials provided with the
        distribution.
        THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
        INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
        DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL,
        EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF
        USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT
        LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED
        OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this
        list of conditions and the following disclaimer in the documentation and/or other materials provided with the
        distribution.
        3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
        promote products derived from this software without specific prior written permission.
        THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
        INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
        DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL,
        EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF
        USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT
        LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED
        OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "LGPL": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General
        Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any
        later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
        implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.""",
    "AGPL": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General
        Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any
        later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
        implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish,
        use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
        commercial or non-commercial, and by any means.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless
        required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
        BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.""",
    "GPL": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
        version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
        implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.""",
}


def longest_increasing(values: list[int]) -> list[int]:
    """Places of a longest increasing run of distinct values, by patience sorting."""
    tops: list[int] = []
    at: list[int] = []
    back = [-1] * len(values)
    for i, v in enumerate(values):
        pile = bisect_left(tops, v)
        if pile == len(tops):
            tops.append(v)
            at.append(i)
        else:
            tops[pile], at[pile] = v, i
        back[i] = at[pile - 1] if pile else -1
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def patience(text: list[int], template: list[int]) -> list[tuple[int, int]]:
    """Matched (text place, template place) pairs, increasing in both."""
    out: list[tuple[int, int]] = []
    work = [(0, len(text), 0, len(template))]
    while work:
        a, b, c, d = work.pop()
        while a < b and c < d and text[a] == template[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a >= b or c >= d:
            continue
        places: list[dict[int, int]] = []
        for seq, x, y in ((text, a, b), (template, c, d)):
            once: dict[int, int] = {}
            for i in range(x, y):
                once[seq[i]] = i if seq[i] not in once else -1
            places.append(once)
        anchors = sorted((j, places[0][w]) for w, j in places[1].items() if j >= 0 and places[0].get(w, -1) >= 0)
        kept = [anchors[i] for i in longest_increasing([t for _, t in anchors])]
        if not kept:
            continue
        for (j0, t0), (j1, t1) in zip([(c - 1, a - 1), *kept], [*kept, (d, b)]):
            work.append((t0 + 1, t1, j0 + 1, j1))
        out += [(t, j) for j, t in kept]
    return sorted(out)


class Templates:
    def __init__(self, templates: dict[str, str]):
        self.names = sorted(templates)
        self.words, self.key = [], []                            # key: where the words begin that name the license
        for name in self.names:
            head = np.frombuffer(templates[name].lower().partition("|")[0].encode(), np.uint8)
            self.key.append(len(words(head, np.array([0, len(head)]))[0]) if "|" in templates[name] else None)
            data = np.frombuffer(templates[name].lower().encode(), np.uint8)
            start, end, _ = words(data, np.array([0, len(data)]))
            self.words.append(Rolling(data).of(start, end).tolist())
        self.vocabulary = np.unique(np.array([w for t in self.words for w in t], dtype=np.uint64))
        self.has = np.stack([np.isin(self.vocabulary, np.array(t, dtype=np.uint64)) for t in self.words])
        self.seen = np.zeros(1 << 16, dtype=bool)
        self.seen[self.vocabulary & np.uint64(0xFFFF)] = True

    def find(self, data: np.ndarray, offsets: np.ndarray, coverage: float, slack: float):
        """(row, template, first byte, end byte in the row, matched, coverage) of what stays after overlaps."""
        start, end, row = words(data, offsets)
        h = Rolling(data).of(start, end)
        maybe = np.flatnonzero(self.seen[h & np.uint64(0xFFFF)])
        at = np.minimum(np.searchsorted(self.vocabulary, h[maybe]), len(self.vocabulary) - 1)
        known = self.vocabulary[at] == h[maybe]
        place, at = maybe[known], at[known]
        found = []
        for t, template in enumerate(self.words):
            need, wide = -int(-coverage * len(template) // 1), int(slack * len(template)) + 1
            p = place[self.has[t][at]]
            if len(p) < need:
                continue
            last = np.minimum(np.searchsorted(p, p + wide), np.searchsorted(row[p], row[p], side="right"))
            good = np.flatnonzero(last - np.arange(len(p)) >= need)
            if not len(good):
                continue
            # Neighbouring candidate stretches are one region.
            low, high = p[good], p[last[good] - 1] + 1
            cut = np.flatnonzero((low[1:] >= np.maximum.accumulate(high)[:-1]) | (row[low[1:]] != row[low[:-1]])) + 1
            for g in np.split(np.arange(len(low)), cut):
                a, b = int(low[g[0]]), int(high[g].max())
                found += [(int(row[a]), t, a + x, a + y, m) for x, y, m in (
                    self._inside(h[a:b].tolist(), template, need, wide) if self.key[t] is None else
                    self._named(h[a:b].tolist(), template, self.key[t], need, wide))]
        found.sort(key=lambda f: (f[0], -f[4], -f[4] / len(self.words[f[1]]), f[2], f[1]))
        kept: list[tuple] = []
        taken: dict[int, list[tuple[int, int]]] = {}                          # of each row, in order; none over another
        for f in found:
            own = taken.setdefault(f[0], [])
            i = bisect(own, (f[2], f[3]))
            if (i == 0 or own[i - 1][1] <= f[2]) and (i == len(own) or f[3] <= own[i][0]):
                own.insert(i, (f[2], f[3]))
                kept.append(f)
        return [(r, t, int(start[a] - offsets[r]), int(end[b - 1] - offsets[r]), m, m / len(self.words[t])) for r, t, a, b, m in sorted(kept)]

    @staticmethod
    def _named(text: list[int], template: list[int], key: int, need: int, wide: int):
        """As ``_inside``, where the template's words from ``key`` on stand in the text in one piece."""
        name, done = template[key:], 0
        for at in range(len(text) - len(name) + 1):
            if at >= done and text[at:at + len(name)] == name:
                low = max(done, at + len(name) - wide)
                pairs = patience(text[low:at], template[:key])
                if len(pairs) + len(name) >= need:
                    done = at + len(name)
                    yield low + pairs[0][0] if pairs else at, done, len(pairs) + len(name)

    @staticmethod
    def _inside(text: list[int], template: list[int], need: int, wide: int):
        """(first, end, matched) of the template's findings in a region, left to right, none over another."""
        own, at = set(template), 0
        while at < len(text):
            if text[at] in own:
                pairs = patience(text[at:at + wide], template)
                if len(pairs) >= need:
                    # A later start may match more.
                    step, best = 1, (len(pairs), at, pairs)
                    while step <= pairs[-1][0] and len(best[2]) < len(template):
                        if text[at + step] in own:
                            other = patience(text[at + step:at + step + wide], template)
                            if len(other) > best[0]:
                                best = (len(other), at + step, other)
                        step += 1
                    n, base, pairs = best
                    yield base + pairs[0][0], base + pairs[-1][0] + 1, n
                    at = base + pairs[-1][0] + 1
                    continue
            at += 1


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = 0.8, slack: float = 1.5) -> DataFrame:
    """One row per finding: doc_id, license, coverage, n_matched, start, end (UTF-8 bytes of the lower-case text).

    ``docs`` needs doc_id and text; whole texts are scanned.  Null and empty
    texts have no findings; a null doc_id stays null; rows that repeat a
    doc_id are scanned one by one; other columns are ignored; an empty table
    gives no rows.  Of findings that overlap the one with more matched words
    stays, of equal ones that of the larger share, then the earlier.  Very long
    texts are searched whole, each as a chunk of its own.  ``slack``: a finding may spread over that many times the
    template's words.
    """
    book = Templates(templates or TEMPLATES)

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            text = pc.utf8_lower(batch.column(1).cast(pa.large_string()).fill_null(""))
            for a, _, data, offsets in text_chunks(text):
                f = [(ids[a + r], book.names[t], c, m, x, y) for r, t, x, y, m, c in book.find(data, offsets, coverage, slack)]
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in f], kind) for i, kind in enumerate(kinds)],
                                                 names=["doc_id", "license", "coverage", "n_matched", "start", "end"])

    kinds = [pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, license string, coverage double, n_matched long, start long, end long")
