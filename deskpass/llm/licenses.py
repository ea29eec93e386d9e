"""Licence scans by patience alignment of public licence texts with documents.

For every template, windows of a document that hold enough of the template's words
are aligned with it: words that occur once in the window and once in the template are
anchors, the longest increasing subsequence of anchors is kept, and the gaps between
them are aligned the same way (equal words at a gap's ends first). The aligned share
of the template's words is the coverage; a window covers the template if it reaches
``least``. One pass over whole texts in the tasks that scan them, no shuffle.

A document is looked at closely only if it holds one of a template's cue words, which
an alignment of the least coverage can't do without: cues are enough of the template's
words, rarest among templates first, that ``least`` of it can't avoid them all.

Defined cases: null and empty texts match nothing; several occurrences give one row
each, without overlaps: the most aligned words win, then the higher coverage, the
earlier place, the template's name; repeated rows give repeated results; an empty table gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from deskpass.llm.common import bounded_batches, col, need

LEAST = 0.8
SHORT = 10   # notices of fewer words must be covered whole: one word may tell two licences apart
SLACK = 1.5  # window length in template lengths
_WORD = re.compile(r"[^\W_]+(?:\.[0-9]+)*")

_WARRANTY = ("THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
             "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS ")
_DEALINGS = ("BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, "
             "OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS in the Software.")
_BSD_DISCLAIMER = (" THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
                   "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
                   "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
                   "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
                   "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
                   "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE "
                   "USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
_BSD_THIRD = (" Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
              "derived from this software without specific prior written permission.")


def _gnu(licence: str, version: str, what: str = "program", after: str = ",") -> str:
    return (f"This {what} is free software{':' if after == ',' else ';'} you can redistribute it and/or modify it under the terms of the "
            f"GNU {licence} as published by the Free Software Foundation{after} either version {version} of the License, or (at your "
            f"option) any later version. This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; "
            f"without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {licence} for more details.")


# Public licence texts and notices by SPDX identifier. Of siblings, the one with the most
# aligned words wins, then the one covered best: words that only one has decide.
TEMPLATES = {
    "MIT-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
           "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
           "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
           "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
           "copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MIT-notice": "Released under the MIT License.",
    "MIT-notice-licensed": "Licensed under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                  "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
                  "Unless required by applicable law or agreed to in writing, software distributed under the License is "
                  "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
                  "See the License for the specific language governing permissions and limitations under the License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
               "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
               "option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
               "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the "
               "GNU General Public License for more details.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "BSD-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
                    "that the following conditions are met: Redistributions of source code must retain the above copyright "
                    "notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce "
                    "the above copyright notice, this list of conditions and the following disclaimer in the documentation "
                    "and/or other materials provided with the distribution.",
    "BSD-notice": "Licensed under the BSD License.",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "all-rights-reserved": "Copyright. All rights reserved.",
}

TEMPLATES |= {
    "MIT": TEMPLATES["MIT-permission"] + " " + _WARRANTY + "OR COPYRIGHT HOLDERS " + _DEALINGS,
    "BSD-2-Clause": TEMPLATES["BSD-conditions"] + _BSD_DISCLAIMER,
    "BSD-3-Clause": TEMPLATES["BSD-conditions"] + _BSD_THIRD + _BSD_DISCLAIMER,
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
           "provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" "
           "AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY "
           "AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY "
           "DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER "
           "TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, "
                 "compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, "
                 "commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors "
                 "of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication "
                 "for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to "
                 "be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. "
                 + _WARRANTY + _DEALINGS,
    "GPL-2.0": _gnu("General Public License", "2", after=";"),
    "LGPL-2.1": _gnu("Lesser General Public License", "2.1", "library", ";"),
    "LGPL-3.0": _gnu("Lesser General Public License", "3"),
    "AGPL-3.0": _gnu("Affero General Public License", "3"),
    "LGPL-2.1-notice": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL-3.0-notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0-notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
               "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "MPL-2.0-notice": "Licensed under the Mozilla Public License, Version 2.0.",
    "ISC-notice": "Licensed under the ISC License.",
}


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Patience alignment: increasing pairs (i, j) with a[i] == b[j]."""
    pairs: list[tuple[int, int]] = []
    gaps = [(0, len(a), 0, len(b))]
    while gaps:
        i, m, j, n = gaps.pop()
        while i < m and j < n and a[i] == b[j]:
            pairs.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1] == b[n - 1]:
            m, n = m - 1, n - 1
            pairs.append((m, n))
        if i >= m or j >= n:
            continue
        in_a, in_b = Counter(a[i:m]), Counter(b[j:n])
        place = {w: k for k, w in enumerate(b[j:n], j) if in_b[w] == 1}
        anchors = [(k, place[w]) for k, w in enumerate(a[i:m], i) if in_a[w] == 1 and w in place]
        chain = _increasing(anchors)
        if not chain:
            continue
        pairs += chain
        at = (i - 1, j - 1)
        for end in [*chain, (m, n)]:
            gaps.append((at[0] + 1, end[0], at[1] + 1, end[1]))
            at = end
    return sorted(pairs)


def _increasing(anchors: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence with growing second members (patience sorting)."""
    tops: list[int] = []
    last: list[int] = []
    before: list[int] = []
    for k, (_, j) in enumerate(anchors):
        p = bisect_left(tops, j)
        before.append(last[p - 1] if p else -1)
        if p == len(tops):
            tops.append(j)
            last.append(k)
        else:
            tops[p], last[p] = j, k
    out, k = [], last[-1] if last else -1
    while k >= 0:
        out.append(anchors[k])
        k = before[k]
    return out[::-1]


@dataclass
class Template:
    name: str
    words: list[str]
    counts: Counter
    cues: set[str]
    needed: int


def templates(texts: dict[str, str], least: float = LEAST) -> list[Template]:
    """Templates with their cue words; those without words are left out."""
    words = {k: [w.lower() for w in _WORD.findall(t)] for k, t in texts.items()}
    spread = Counter(w for ws in words.values() for w in set(ws))
    out = []
    for name, ws in words.items():
        if not ws:
            continue
        needed = len(ws) if len(ws) < SHORT else -(-round(least * len(ws) * 1e6) // 10 ** 6)
        counts, cues, avoided = Counter(ws), set(), len(ws)
        # long words that few templates have, until what is left can't reach the coverage
        for w in sorted(counts, key=lambda w: (spread[w], -len(w), w)):
            if avoided < needed:
                break
            cues.add(w)
            avoided -= counts[w]
        out.append(Template(name, ws, counts, cues, needed))
    return out


def _windows(words: list[str], t: Template) -> Iterator[tuple[int, int]]:
    """Stretches, each merged from windows of the slack length that hold enough of the template's words."""
    size = max(len(t.words), int(SLACK * len(t.words)))
    at = [i for i, w in enumerate(words) if w in t.counts]
    stretch: tuple[int, int] | None = None
    have: Counter = Counter()
    held, first = 0, 0
    for k, i in enumerate(at):
        w = words[i]
        have[w] += 1
        held += have[w] <= t.counts[w]
        while i - at[first] >= size:
            old = words[at[first]]
            held -= have[old] <= t.counts[old]
            have[old] -= 1
            first += 1
        if held >= t.needed:
            start = at[first]
            if stretch and start <= stretch[1]:
                stretch = stretch[0], i + 1
            else:
                if stretch:
                    yield stretch
                stretch = start, i + 1
    if stretch:
        yield stretch


def _matches(words: list[str], start: int, end: int, t: Template) -> Iterator[tuple[int, int, int]]:
    """(aligned words, first word, last word) of occurrences within a stretch, best first, then left and right of it."""
    size = max(len(t.words), int(SLACK * len(t.words)))
    todo = [(start, end)]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < t.needed:
            continue
        best: tuple[int, int, int] | None = None
        # windows that begin at a word of the template; a long stretch is cut at every such word
        begins = [lo] if hi - lo <= size else [i for i in range(lo, hi) if words[i] in t.counts]
        for i in begins:
            pairs = align(words[i:min(hi, i + size)], t.words)
            if len(pairs) >= t.needed and (best is None or len(pairs) > best[0]):
                best = len(pairs), i + pairs[0][0], i + pairs[-1][0]
        if best:
            yield best
            todo += [(best[2] + 1, hi), (lo, best[1])]


def scan(text: str | None, known: list[Template]) -> list[tuple[str, float, int, int]]:
    """(template, coverage, start, end) with character offsets, in text order."""
    if not text:
        return []
    lower = text.lower()
    likely = [t for t in known if any(c in lower for c in t.cues)]
    if not likely:
        return []
    spans = [(m.start(), m.end()) for m in _WORD.finditer(text)]
    words = [text[a:b].lower() for a, b in spans]
    own = set(words)
    out = []
    for t in likely:
        if own.isdisjoint(t.cues) or sum(n for w, n in t.counts.items() if w in own) < t.needed:
            continue
        for start, end in _windows(words, t):
            for n, i, j in _matches(words, start, end, t):
                out.append((n, t.name, round(n / len(t.words), 6), spans[i][0], spans[j][1]))
    # where templates overlap, the one with the most aligned words tells the licence
    kept: list[tuple[str, float, int, int]] = []
    for _, *m in sorted(out, key=lambda m: (-m[0], -m[2], m[3], m[1])):
        at = bisect_left(kept, m[2], key=lambda k: k[2])
        if (at == 0 or kept[at - 1][3] <= m[2]) and (at == len(kept) or kept[at][2] >= m[3]):
            kept.insert(at, tuple(m))
    return kept


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text: str = "text", texts: dict[str, str] | None = None,
                  least: float = LEAST) -> DataFrame:
    """One row per occurrence: doc_id, license, coverage, start_char, end_char."""
    need(docs, id_col, text)
    bounded_batches(docs.sparkSession)
    known = templates(texts or TEMPLATES, least)
    narrow = docs.select(col(id_col).alias("doc_id"), col(text).cast("string").alias("t"))
    schema = (narrow.select("doc_id").schema.add("license", "string").add("coverage", "double")
              .add("start_char", "long").add("end_char", "long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, at = [], []
            for i, t in enumerate(b.column(1)):
                for r in scan(t.as_py(), known):
                    rows.append(r)
                    at.append(i)
            kinds = (pa.string(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(at, pa.int64())), *[pa.array([r[k] for r in rows], kinds[k]) for k in range(4)]],
                schema.names)

    return narrow.mapInArrow(run, schema)
