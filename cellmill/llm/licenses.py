"""License scans by patience alignment.

A text and a template are aligned on words that occur exactly once in both: the
longest increasing subsequence of their places gives anchors, and the gaps
between anchors are aligned in the same way, where more words have become
unique.  Matched words that lie close together make a finding; its coverage is
the share of the template that they match.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellmill.llm.common import text_of

#: Notices and texts of public licenses.
TEMPLATES: dict[str, str] = {
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "MIT-notice": "Released under the MIT License.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "GPL-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "LGPL-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
    "LGPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "AGPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "EPL-2.0-header": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
}

_WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def rising(values: list[int]) -> list[int]:
    """Indices of a longest strictly increasing subsequence, by piles."""
    tops: list[int] = []
    ends: list[int] = []
    before: list[int] = []
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        before.append(ends[k - 1] if k else -1)
        tops[k : k + 1] = [v]
        ends[k : k + 1] = [i]
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def align(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """Matched (text place, template place), both increasing."""
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
        wanted = Counter(template[c:d])
        there: dict[str, list[int]] = {}
        for i in range(a, b):
            if wanted.get(text[i]) == 1:
                there.setdefault(text[i], []).append(i)
        pairs = [(there[w][0], k) for k in range(c, d) if wanted[w := template[k]] == 1 and len(there.get(w, ())) == 1]
        anchors = [pairs[i] for i in rising([i for i, _ in pairs])]
        if not anchors:
            continue
        edges = [(a - 1, c - 1), *anchors, (b, d)]
        out += anchors
        work += [(p[0] + 1, q[0], p[1] + 1, q[1]) for p, q in zip(edges, edges[1:], strict=False)]
    return sorted(out)


def regions(words: list[str], vocabulary: frozenset[str], apart: int) -> list[tuple[int, int]]:
    """Stretches of the text around words of the template that stand no more than ``apart`` words from each other."""
    hits = [i for i, w in enumerate(words) if w in vocabulary]
    out: list[list[int]] = []
    for i in hits:
        if out and i - out[-1][1] <= apart:
            out[-1][1] = i
        else:
            out.append([i, i])
    return [(a, b + 1) for a, b in out]


def matches(words: list[str], template: list[str], apart: int, least: float) -> list[list[int]]:
    """The places of the matched words of every finding of the template that reaches the coverage; findings may overlap.

    What stands before and behind a finding is searched again.  A stretch that holds the template more than once has no
    unique words; it is halved at its middle, with an overlap of the template's length, until it has.
    """
    need = least * len(template)
    found: list[list[int]] = []
    work = regions(words, frozenset(template), apart)
    while work:
        a, b = work.pop()
        if b - a < need:
            continue
        clusters: list[list[int]] = []
        for i, _ in align(words[a:b], template):
            if clusters and a + i - clusters[-1][-1] <= apart:
                clusters[-1].append(a + i)
            else:
                clusters.append([a + i])
        top = max(clusters, key=len, default=[])
        if len(top) >= need and 2 * len(top) >= top[-1] + 1 - top[0]:
            found.append(top)
            work += [(a, top[0]), (top[-1] + 1, b)]
        elif 4 * (b - a) > 5 * len(template):
            middle, lap = (a + b) // 2, len(template) // 2
            left, right = min(middle + lap, b - 1), max(middle - lap, a + 1)
            work += [(a, left), (right, b)]
    return found


@lru_cache(maxsize=4)
def _prepared(templates: tuple[tuple[str, str], ...]):
    out = [(name, words_of(text)) for name, text in templates]
    return [(name, w, Counter(w)) for name, w in out if w], frozenset(x for _, w in out for x in w)


def findings(text: str, templates: tuple[tuple[str, str], ...], least: float, apart: int) -> list[tuple[str, float, int, int, int]]:
    """(license, coverage, matched words, first word, end word) of all findings, the closest first.

    Most matched words win, then coverage, template order and the earlier place.  A word of the text counts for one
    finding only; those that come later keep their other words, and are dropped if these don't reach the coverage.
    """
    prepared, vocabulary = _prepared(templates)
    words = words_of(text)
    met = vocabulary.intersection(words)
    waiting = []
    for rank, (_, template, counts) in enumerate(prepared):
        if sum(n for w, n in counts.items() if w in met) < least * len(template):
            continue  # the words that are there can't reach the coverage in any order
        waiting += [(-len(at), len(template), rank, at) for at in matches(words, template, apart, least)]
    heapify(waiting)
    out, taken = [], set()
    while waiting:
        n, size, rank, at = heappop(waiting)
        free = [i for i in at if i not in taken]
        if len(free) == -n:
            out.append((prepared[rank][0], len(at) / size, len(at), at[0], at[-1] + 1))
            taken.update(at)
        elif len(free) >= least * size:
            heappush(waiting, (-len(free), size, rank, free))
    return out


def license_scan(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] = TEMPLATES, least: float = 0.8, apart: int = 12
) -> DataFrame:
    """One row per input row: id_col, license (null if none is found), coverage, matched_words, first_word, end_word, findings.

    findings: all of the text as an array of structs with the same fields, the closest first, which is the one in the
    columns before; empty if there is none.  Only the given templates are looked for.  least: share of a template's words that a finding must match.  apart: words that may stand between neighbouring
    matches.  Null text counts as empty; ids may be null or repeat; of equal findings the earliest counts.
    """
    kind = df.schema[id_col].dataType.simpleString()
    fixed = tuple(templates.items())
    fields = {"license": pa.string(), "coverage": pa.float64(), "matched_words": pa.int32(), "first_word": pa.int32(), "end_word": pa.int32()}
    none = (None, 0.0, 0, 0, 0)

    def find(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            found = [findings(t, fixed, least, apart) for t in batch.column(1).to_pylist()]
            columns = [pa.array([f[0][k] if f else none[k] for f in found], t) for k, t in enumerate(fields.values())]
            every = pa.array([[dict(zip(fields, x, strict=True)) for x in f] for f in found], pa.list_(pa.struct(list(fields.items()))))
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, every], [id_col, *fields, "findings"])

    one = "license string, coverage double, matched_words int, first_word int, end_word int"
    schema = f"`{id_col}` {kind}, {one}, findings array<struct<{one}>>"
    return df.select(F.col(id_col), text_of(df, text_col).alias("_text")).mapInArrow(find, schema)
