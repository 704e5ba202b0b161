"""License scans by patience alignment.

Words that stand once in both the text and a template are anchors; the longest run of anchors
that ascends in both is kept; equal words beside anchors are taken in, and the gaps between
anchors are aligned in the same way. Coverage is the share of a template's words that the
alignment finds.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from .runtime import pick

#: Notices and permission texts of public licenses, by SPDX identifier: fixed values.
TEMPLATES: dict[str, str] = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required "
        "by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
        "governing permissions and limitations under the License."
    ),
    "MIT": "Released under the MIT License.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and "
        "this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "MIT-license": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and "
        "this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "
        "\"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS "
        "BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, "
        "OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "BSD-3-Clause-license": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
        "promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE "
        "COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE "
        "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE "
        "COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL "
        "DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR "
        "BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT "
        "(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE "
        "POSSIBILITY OF SUCH DAMAGE."
    ),
    "ISC-license": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" "
        "AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY "
        "AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY "
        "DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER "
        "TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable "
        "for any damages arising from the use of this software. Permission is granted to anyone to use this software for any "
        "purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following "
        "restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original "
        "software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but "
        "is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the "
        "original software. 3. This notice may not be removed or altered from any source distribution."
    ),
    "Unlicense-text": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, "
        "compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, "
        "commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of "
        "this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for "
        "the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an "
        "overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE "
        "SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE "
        "LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT "
        "OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
}

WORD = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def windows(words: list[str], template: list[str], least: float) -> Iterator[tuple[int, int]]:
    """Overlapping stretches of one to two templates' length that hold enough of its words."""
    n, held = len(template), set(template)
    step = max(1, n // 8)
    upto = [0, *accumulate(w in held for w in words)]
    for begin in range(0, len(words), step):
        for size in (n + step, n + n // 2, 2 * n):
            end = min(begin + size, len(words))
            if upto[end] - upto[begin] >= least * n:
                yield begin, end


def ascending(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, sorted by the first number, whose second numbers ascend."""
    tops: list[int] = []
    piles: list[int] = []
    back: list[int] = []
    for i, (_, b) in enumerate(pairs):
        k = bisect_left(tops, b)
        back.append(piles[k - 1] if k else -1)
        if k == len(tops):
            tops.append(b)
            piles.append(i)
        else:
            tops[k] = b
            piles[k] = i
    out = []
    i = piles[-1] if piles else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def patience(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """Pairs (text index, template index) of the patience alignment, ascending in both.

    Gaps wait on a list, not on the call stack; a gap without an anchor is left after words that
    are equal at its ends have been taken in.
    """
    out: list[tuple[int, int]] = []
    gaps = [(0, len(text), 0, len(template))]
    while gaps:
        a, b, c, d = gaps.pop()
        inner = a > 0 or c > 0
        while inner and a < b and c < d and text[a] == template[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while (b < len(text) or d < len(template)) and a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a == b or c == d:
            continue
        wanted = Counter(template[c:d])
        once = {w: c + i for i, w in enumerate(template[c:d]) if wanted[w] == 1}
        held = Counter(w for w in text[a:b] if w in once)
        pairs = [(a + i, once[w]) for i, w in enumerate(text[a:b]) if held.get(w) == 1]
        anchors = ascending(pairs)
        if not anchors:
            continue
        out += anchors
        edges = [(a - 1, c - 1), *anchors, (b, d)]
        gaps += [(p + 1, r, q + 1, s) for (p, q), (r, s) in zip(edges, edges[1:], strict=False) if r > p + 1 and s > q + 1]
    return sorted(out)


def dense_stretch(pairs: list[tuple[int, int]], n_template: int) -> list[tuple[int, int]]:
    """The aligned words of one place: the part of ``pairs`` that no gap of over twice the template cuts."""
    best: list[tuple[int, int]] = []
    part: list[tuple[int, int]] = []
    for p in pairs:
        if part and p[0] - part[-1][0] > 2 * n_template:
            best, part = max(best, part, key=len), []
        part.append(p)
    return max(best, part, key=len)


def apart(found: list[tuple], key: Callable) -> list[tuple]:
    """The best of ``found`` (license, coverage, n_matched, first, end) by ``key`` that don't overlap, by place."""
    kept: list[tuple] = []
    for f in sorted(found, key=key):
        if all(f[4] <= k[3] or k[4] <= f[3] for k in kept):
            kept.append(f)
    return sorted(kept, key=lambda f: (f[3], f[0]))


def between(words: list[str], template: list[str], least: float, begin: int, end: int) -> list[tuple[int, int]]:
    """The longest alignment that reaches the coverage around one occurrence of a rare word in [begin, end), if any.

    A place lacks a share of 1 - ``least`` of the template at most. So of one word more than that, of words that stand once in
    the template, each place has one, and between that word's neighbours in the text it stands once.
    """
    counts = Counter(template)
    at: dict[str, list[int]] = {w: [] for w, n in counts.items() if n == 1}
    upto = [0]
    for i in range(begin, end):
        upto.append(upto[-1] + (words[i] in counts))
        if words[i] in at:
            at[words[i]].append(i)
    rare = sorted(at.values(), key=len)[: int((1 - least) * len(template) + 1e-9) + 1]
    best: list[tuple[int, int]] = []
    for places_of in rare:
        edges = [begin - 1, *places_of, end]
        for low, high in zip(edges, edges[2:], strict=False):
            if upto[high - begin] - upto[low + 1 - begin] >= max(least * len(template), len(best) + 1):
                pairs = dense_stretch(patience(words[low + 1 : high], template), len(template))
                if len(pairs) >= least * len(template) and len(pairs) > len(best):
                    best = [(a + low + 1, c) for a, c in pairs]
    return best


def places(name: str, words: list[str], template: list[str], least: float) -> list[tuple]:
    """Every place where the template's alignment reaches the coverage, none overlapping another.

    The whole text is aligned as one, and every stretch that holds enough of the template's words: of
    a notice that stands several times, no word stands once in the whole text, but in a stretch. What is
    left before, between and behind the places found is searched around its rare words, until nothing is found.
    """
    found = []
    tried = [(0, dense_stretch(patience(words, template), len(template)))]
    tried += [(begin, patience(words[begin:end], template)) for begin, end in windows(words, template, least)]
    for begin, pairs in tried:
        if len(pairs) >= least * len(template):
            found.append((name, len(pairs) / len(template), len(pairs), begin + pairs[0][0], begin + pairs[-1][0] + 1))
    found = apart(list(dict.fromkeys(found)), lambda f: (-f[2], f[4] - f[3], f[3]))
    edges = [0, *(x for f in found for x in f[3:5]), len(words)]
    rest = list(zip(edges[::2], edges[1::2], strict=True))
    while rest:
        begin, end = rest.pop()
        pairs = between(words, template, least, begin, end) if end - begin >= least * len(template) else []
        if pairs:
            first, last = pairs[0][0], pairs[-1][0] + 1
            found.append((name, len(pairs) / len(template), len(pairs), first, last))
            rest += [(begin, first), (last, end)]
    return sorted(found, key=lambda f: (f[3], f[0]))


def scanner(templates: dict[str, str], least: float) -> Callable:
    prepared = {name: w for name, t in sorted(templates.items()) if (w := words_of(t))}
    counts = {name: Counter(t) for name, t in prepared.items()}
    vocabulary = {w for t in prepared.values() for w in t}

    def all_places(text: str | None) -> list[tuple]:
        words = words_of(text) if text else []
        present = vocabulary.intersection(words)
        found = []
        for name, template in prepared.items():
            if sum(n for w, n in counts[name].items() if w in present) < least * len(template):
                continue  # too few of its words are there for the coverage asked
            found += places(name, words, template, least)
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
        names = ("license", "coverage", "n_matched", "first_word", "end_word")
        notice = pa.list_(pa.struct(list(zip(names, kinds, strict=True))))
        for batch in batches:
            rows, notices = [], []
            for t in batch.column(1):
                found = all_places(t.as_py())
                rows.append(min(found, key=lambda f: (-f[1], -f[2], f[0], f[3]), default=(None, 0.0, 0, None, None)))
                # a longer notice stands before a shorter one inside it
                notices.append([dict(zip(names, f, strict=True)) for f in apart(found, lambda f: (-f[2], -f[1], f[0], f[3]))])
            columns = zip(*rows, strict=True) if rows else [()] * len(names)
            made = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made, pa.array(notices, notice)], names=["doc_id", *names, "notices"])

    return run


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = 0.8) -> DataFrame:
    """(doc_id, license, coverage, n_matched, first_word, end_word, notices) for every row of ``docs``.

    ``notices`` are all places of ``least`` coverage or more, in order, none overlapping another; where
    two would, the longer match stands. The other columns are those of the highest coverage, the longer
    match first, then by name and place; null with coverage 0 where there is none, as for a null or
    empty text. Word numbers are those of the text's words; repeated rows are judged one by one; no rows
    give none. Templates without a word match nothing; no templates leave every text without a license.
    """
    rows = pick(docs, doc_id="bigint", text="string")
    one = "license: string, coverage: double, n_matched: bigint, first_word: bigint, end_word: bigint"
    schema = f"doc_id bigint, {one.replace(':', '')}, notices array<struct<{one}>>"
    return rows.mapInArrow(scanner(TEMPLATES if templates is None else templates, least), schema)
