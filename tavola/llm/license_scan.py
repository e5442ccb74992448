"""License scans (operator 10): patience alignment with license templates.

Texts and templates become words of letters and digits, lower-case.  A place
in a text is tried against a template when enough of the template's telling
words (all but function words) stand close together there: a template that is
covered to ``coverage`` cannot miss more of them than the words it may lack.
There, the window of the text is aligned with the template: words unique to
both are anchors, the longest increasing subsequence of them is kept, and the
gaps between are aligned the same way; in small gaps without anchors the
longest common subsequence decides.  A template matches where the aligned
words cover at least ``coverage`` of it and of their span in the text; of the words that a near kin (a template that
covers as much of it) lacks, as large a share must be aligned, and a short one needs the words that among the
short ones only it and its near kin have.  Of overlapping matches the one with more aligned words holds.

A window must hold enough telling words, each counted no oftener than the template
has it; after one that does not align the next begins a quarter of the template
further on, and holds what begins in between: time grows with the text.

Cases: a null or empty text has no licenses; whole texts are scanned, however long; repeated rows and null ids are scanned each for itself; other columns
are ignored; an empty table or no template gives rows without licenses.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tavola.llm import textkernel as K

_WITHOUT = ("This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
            "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} for more details.")
_FREE = ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as "
         "published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version. " + _WITHOUT)
_BSD_2 = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
          "conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
          "disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
          "in the documentation and/or other materials provided with the distribution. ")
_BSD_3 = _BSD_2 + ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
                   "this software without specific prior written permission. ")
_BSD_AS_IS = ("THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT "
              "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT "
              "HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
              "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY "
              "THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
              "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
_ISC = ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies. ")

# fixed values: notices by which works state their license; short whole texts ("-text"), headers, and the titles of long texts
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to "
        "in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
        "either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "MIT": "Released under the MIT License",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial "
        "portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED "
        "TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT "
        "HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR "
        "IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-3.0-header": _FREE.format("General Public License", "3"),
    "GPL-3.0-title": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2",
    "GPL-2.0-header": _FREE.format("General Public License", "2"),
    "GPL-2.0-title": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3",
    "LGPL-3.0-header": _FREE.format("Lesser General Public License", "3"),
    "LGPL-3.0-title": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "LGPL-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1",
    "LGPL-2.1-header": _FREE.format("Lesser General Public License", "2.1"),
    "LGPL-2.1-title": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3",
    "AGPL-3.0-header": _FREE.format("Affero General Public License", "3"),
    "AGPL-3.0-title": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    "BSD-2-Clause": _BSD_2,
    "BSD-2-Clause-text": _BSD_2 + _BSD_AS_IS,
    "BSD-2-Clause-notice": "Released under the BSD 2-Clause License",
    "BSD-3-Clause": _BSD_3,
    "BSD-3-Clause-text": _BSD_3 + _BSD_AS_IS,
    "BSD-3-Clause-notice": "Released under the BSD 3-Clause License",
    "ISC": _ISC,
    "ISC-text": _ISC + "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED "
        "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR "
        "ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
        "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with "
        "this file, You can obtain one at",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0",
    "Unlicense": "This is free and unencumbered software released into the public domain",
    "Unlicense-text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, "
        "sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by "
        "any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in "
        "the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and "
        "successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software "
        "under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, "
        "DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE "
        "USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "CC0-1.0": "This work is dedicated to the public domain under the Creative Commons CC0 1.0 Universal dedication",
    "all-rights-reserved": "All rights reserved",
}
_COMMON = frozenset("a an the of to in on at by for with without or and any all this that these is are be as it its not no you may if from such other "
                    "shall will under out which".split())
_WORD_BYTE = np.full(256, 32, np.uint8)
for _c in range(256):
    if chr(_c).isalnum() or _c >= 128:
        _WORD_BYTE[_c] = _c + 32 if 65 <= _c <= 90 else _c


SHORT = 20


def words_of(text: str) -> list[bytes]:
    raw = _WORD_BYTE[np.frombuffer(text.encode("utf-8"), np.uint8)].tobytes()
    return raw.split()


def patience(a: list, b: list, small: int = 48) -> list[tuple[int, int]]:
    """Aligned positions (i in a, j in b), ascending in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        al, ah, bl, bh = todo.pop()
        while al < ah and bl < bh and a[al] == b[bl]:
            out.append((al, bl))
            al, bl = al + 1, bl + 1
        while al < ah and bl < bh and a[ah - 1] == b[bh - 1]:
            ah, bh = ah - 1, bh - 1
            out.append((ah, bh))
        if al >= ah or bl >= bh:
            continue
        at: dict = {}
        for i in range(al, ah):
            at[a[i]] = -1 if a[i] in at else i
        bt: dict = {}
        for j in range(bl, bh):
            bt[b[j]] = -1 if b[j] in bt else j
        pairs = [(i, bt[w]) for w, i in at.items() if i >= 0 and bt.get(w, -1) >= 0]  # by position in a
        chain = _increasing(pairs)
        if not chain:
            if (ah - al) * (bh - bl) <= small * small:
                out += [(al + i, bl + j) for i, j in _common(a[al:ah], b[bl:bh])]
            continue
        out += chain
        edges = [(al - 1, bl - 1), *chain, (ah, bh)]
        todo += [(x + 1, x2, y + 1, y2) for (x, y), (x2, y2) in zip(edges, edges[1:])]
    return sorted(out)


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence with rising second parts, by piles."""
    tops: list[int] = []
    last: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        p = bisect_left(tops, j)
        back[k] = last[p - 1] if p else -1
        tops[p: p + 1] = [j]
        last[p: p + 1] = [k]
    out, k = [], last[-1] if last else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def _common(a: list, b: list) -> list[tuple[int, int]]:
    n = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            n[i][j] = n[i + 1][j + 1] + 1 if a[i] == b[j] else max(n[i + 1][j], n[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif n[i + 1][j] >= n[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


class Scanner:
    def __init__(self, templates: dict[str, str], coverage: float = 0.8):
        self.coverage = coverage
        self.names = list(templates)
        self.words = [words_of(templates[n]) for n in self.names]
        vocabulary = sorted({w for ws in self.words for w in ws if w.decode("utf-8", "replace") not in _COMMON})
        h = np.array([_hash(w) for w in vocabulary], np.uint64)
        order = np.argsort(h)
        self.hash = h[order]
        code = {vocabulary[i]: k for k, i in enumerate(order)}
        self.member = np.zeros((len(self.names), len(vocabulary)), bool)
        self.need, self.limit = [], []
        self.key: list[set] = []
        self.apart: list[list[set]] = []  # per template and near kin the positions that the kin lacks
        aligned = [[{j for _, j in patience(u, t)} for u in self.words] for t in self.words]
        kin = [[len(j) >= coverage * len(t) for j in row] for t, row in zip(self.words, aligned)]
        for t, ws in enumerate(self.words):
            rest = [set(range(len(ws))) - j for u, j in enumerate(aligned[t]) if kin[t][u]]
            self.apart.append([lacks for lacks in rest if lacks])
            # a short template is told from the others by the words only it and its kin have
            strange = {w for u, other in enumerate(self.words) if len(other) < SHORT and u != t and not kin[t][u] and not kin[u][t] for w in other}
            self.key.append({w for w in ws if w in code and w not in strange} if len(ws) < SHORT else set())
        for t, ws in enumerate(self.words):
            telling = [w for w in ws if w in code]
            for w in telling:
                self.member[t, code[w]] = True
            may_lack = len(ws) - int(np.ceil(coverage * len(ws)))
            self.need.append(max(1, len(telling) - may_lack))
            self.limit.append({code[w]: telling.count(w) for w in telling})

    def _told_apart(self, t: int, at: set) -> bool:
        ws = self.words[t]
        return self.key[t] <= {ws[j] for j in at} and all(len(lacks & at) >= self.coverage * len(lacks) for lacks in self.apart[t])

    def matches(self, w: K.Words) -> Iterator[tuple[int, str, float, int, int, int]]:
        """(row, license, coverage, first byte, end byte, aligned words) by place."""
        if not len(self.names) or not len(w.starts):
            return
        h = w.hashes()
        at = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        hits = np.flatnonzero(self.hash[at] == h)
        code = at[hits]
        for t, ws in enumerate(self.words):
            mine = self.member[t, code]
            own, word = hits[mine], code[mine]
            if len(own) < self.need[t]:
                continue
            done = least = -1
            for p in self._windows(t, own, word, w.row[own]):
                if p < done or p < least:
                    continue
                row = int(w.row[p])
                lo, hi = max(int(w.rows[row]), done, p - len(ws)), min(int(w.rows[row + 1]), p + 2 * len(ws))
                found = self._align(t, [w.text(k) for k in range(lo, hi)], p - lo)
                if found is None:
                    least = p + max(1, len(ws) // 4)  # the next window holds whatever begins in between
                    continue
                a, z, aligned = found
                yield row, self.names[t], aligned / len(ws), int(w.starts[lo + a]), int(w.ends[lo + z]), aligned
                done = lo + z + 1

    def _windows(self, t: int, own: np.ndarray, word: np.ndarray, row: np.ndarray) -> Iterator[int]:
        """Words where a window begins that has enough of the template's telling words,
        each counted no oftener than the template has it; one pass over the hits."""
        need, span, limit = self.need[t], 2 * len(self.words[t]), self.limit[t]
        quick = (own[need - 1:] - own[: len(own) - need + 1] < span) & (row[need - 1:] == row[: len(row) - need + 1])
        if not quick.any():
            return
        count: dict[int, int] = {}
        places, words, rows, enough, end = own.tolist(), word.tolist(), row.tolist(), 0, 0
        for begin, p in enumerate(places):
            if end <= begin:
                count, enough, end = {}, 0, begin
            while end < len(places) and places[end] - p < span and rows[end] == rows[begin]:
                c = words[end]
                count[c] = count.get(c, 0) + 1
                enough += count[c] <= limit[c]
                end += 1
            if enough >= need:
                yield p
            c = words[begin]
            enough -= count[c] <= limit[c]
            count[c] -= 1

    def _align(self, t: int, text: list[bytes], p: int) -> tuple[int, int, int] | None:
        """First, last and number of the aligned words of a text that holds the template,
        with the ``p`` words before the window or, where those blur it, without them."""
        ws = self.words[t]
        for begin in dict.fromkeys((0, p)):
            pairs = patience(text[begin:], ws)
            if len(pairs) < self.coverage * len(ws):
                return None
            first, last = begin + pairs[0][0], begin + pairs[-1][0]
            if len(pairs) >= self.coverage * (last - first + 1) and self._told_apart(t, {j for _, j in pairs}):
                return first, last, len(pairs)
        return None


def _hash(word: bytes) -> int:
    data = np.frombuffer(word, np.uint8)
    return int(K.span_hashes(K._BYTE_CODE[data], np.array([0]), np.array([len(data)]))[0])


def _best(found: list[tuple]) -> list[tuple]:
    """Of overlapping matches those with more aligned words."""
    out: list[tuple] = []
    for m in sorted(found, key=lambda m: (-m[4], -m[1], m[2], m[0])):
        if all(m[3] <= k[2] or k[3] <= m[2] for k in out):
            out.append(m)
    return sorted(out, key=lambda m: m[2])


def scan(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = 0.8) -> DataFrame:
    """doc_id and ``licenses``, an array of (license, coverage, start, end) in code
    points by place, of every row of docs(doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast((templates if templates is not None else TEMPLATES, coverage))
    kind = "array<struct<license:string,coverage:double,start:bigint,end:bigint>>"
    arrow = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(*shared.value)
        for b in batches:
            out: list[list] = []
            for lo, hi, data, offs in K.text_chunks(b.column(1)):
                found: dict[int, list] = {}
                for row, *m in scanner.matches(K.Words(_WORD_BYTE[data], offs)):
                    found.setdefault(row, []).append(m)
                for r in range(hi - lo):
                    here = []
                    for name, cover, a, z, _ in _best(found.get(r, [])):
                        start = _points(data[offs[r]: a])
                        here.append({"license": name, "coverage": cover, "start": start, "end": start + _points(data[a:z])})
                    out.append(here)
            yield pa.record_batch({"doc_id": b.column(0), "licenses": pa.array(out, arrow)})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(rows, f"doc_id long, licenses {kind}")


def _points(data: np.ndarray) -> int:
    return int(((data & 0xC0) != 0x80).sum())
