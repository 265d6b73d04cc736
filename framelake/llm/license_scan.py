"""Licence scans: winnowed fingerprints of templates, then banded alignment.

Each template's word k-grams are hashed and winnowed: of every window of hashes
the least is kept.  The kept ones form an inverted index from fingerprint to
(template, place).  A text's k-grams are looked up in it; hits that follow each
other in text and template, on diagonals near each other, make a chain, and a
Smith-Waterman alignment in a band of fixed width along the chain reports how
much of the template is covered and where.  What a text holds of a template
besides that, such as another copy, starts a chain of its own.  The work for a
chain is bounded by its template's words times the band's width, however long
the text.  A shared run of gram + window - 1 words is always found; these, the
least coverage and the grant's length are properties of each template.

The templates are a fixed, small set and go to the tasks with the code; texts
are read once, with no shuffle.  Very long texts are scanned whole.

Null and empty texts and texts without a match give no row.  Repeated rows and
null ids are reported row by row.  An empty table gives no rows.  Columns other
than doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

import bisect
from collections import Counter, defaultdict, deque
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import common
from .common import gram_hashes, hash_strings, slices, split_words, text_bytes

#: Half width of the alignment's band, in words; gap of words that ends a chain; chains aligned at a time.
BAND, GAP, CHAINS = 8, 40, 256


class Template(NamedTuple):
    """A notice, the grams it is indexed by, and what counts as finding it.

    Grams of `gram` words are winnowed by windows of `window` of them (1 keeps
    all).  A region counts if `coverage` of the notice's words match, or that
    share of its first `grant` words alone, if given.
    """

    text: str
    gram: int = 5
    window: int = 4
    coverage: float = 0.5
    grant: int | None = None


def line_of(text: str) -> Template:
    """A one-line notice: every gram of three words counts, and an edit takes more of it."""
    return Template(text, 3, 1, 0.8)


#: Public licence notices, as their authors ask for them to be quoted.
TEMPLATES = {
    "MIT": Template('Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.', grant=116),
    "Apache-2.0": Template('Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    "GPL-3.0-or-later": Template("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    "ISC": Template('Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.', grant=58),
    "BSD-2-Clause": Template('Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.', grant=69),
    "BSD-3-Clause": Template('Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.', grant=99),
    "Unlicense": Template('This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to <https://unlicense.org>', grant=45),
    "MPL-2.0": Template("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    "MIT-line": line_of("Released under the MIT License."),
    "Apache-2.0-line": line_of("Licensed under the Apache License, Version 2.0."),
    "GPL-3.0-line": line_of("This work is licensed under the GNU General Public License, version 3."),
    "CC-BY-NC-4.0-line": line_of("Licensed under CC BY-NC 4.0."),
    "CC-BY-4.0-line": line_of("This work is licensed under a Creative Commons Attribution 4.0 International License."),
}


def winnow(hashes: np.ndarray, window: int) -> np.ndarray:
    """Places of the least hash, the last of equal ones, of every window; of all hashes where there is no full window."""
    if len(hashes) <= window:
        return np.unique([len(hashes) - 1 - int(np.argmin(hashes[::-1]))]) if len(hashes) else np.zeros(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(hashes, window)[:, ::-1]
    return np.unique(np.arange(len(views)) + window - 1 - np.argmin(views, axis=1))


def template_words(text: str) -> np.ndarray:
    _, words, _, _ = split_words(pa.array([text]))
    return hash_strings(words)


class Index:
    """Fingerprint to postings (template, place), one table for each gram length."""

    def __init__(self, templates: dict[str, Template]) -> None:
        self.names, self.templates = list(templates), list(templates.values())
        self.words = [template_words(t.text) for t in self.templates]
        self.bags = [Counter(w.tolist()) for w in self.words]
        self.postings: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for t, (template, words) in enumerate(zip(self.templates, self.words, strict=True)):
            gram = max(1, min(template.gram, len(words)))
            grams = gram_hashes(words, gram)
            for place in winnow(grams, template.window) if template.window > 1 else range(len(grams)):
                self.postings[gram][int(grams[place])].append((t, int(place)))
        self.keys = {n: np.sort(np.array(list(p), np.uint64)) for n, p in self.postings.items()}

    def hits(self, words: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray]:
        """Places in `words` whose gram is in the index, and the grams."""
        grams, keys = gram_hashes(words, gram), self.keys[gram]
        if not len(grams):
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(keys[np.minimum(np.searchsorted(keys, grams), len(keys) - 1)] == grams)
        return at, grams[at]

    def enough(self, t: int, matches: int, start: int, end: int) -> bool:
        """Whether so many matches between those places of template t count as finding it."""
        template, n = self.templates[t], len(self.words[t])
        grant = template.grant or n
        return matches >= template.coverage * n or matches - max(0, end - max(start, grant)) >= template.coverage * grant

    def least(self, t: int) -> float:
        return self.templates[t].coverage * (self.templates[t].grant or len(self.words[t]))


def align(text: np.ndarray, template: np.ndarray, spans: np.ndarray, diagonals: np.ndarray, band: int = BAND) -> list[tuple[int, int, int, int, int, int]]:
    """The best local alignment of each of the text's spans within its band: score, matches, text start and end, template start and end.

    A match scores 2, another pair, and a word of one side alone, -1.  Of span
    c, template word i may meet the words within `band` of i + diagonals[c, i].
    Of equal alignments the one that ends first, in the template, then in the
    text.  All spans go through the template's words together.
    """
    width, n, count = 2 * band + 1, len(template), len(spans)
    base, step, rows = np.arange(n) + diagonals - band, np.arange(width), np.arange(count)[:, None]
    scores, same = np.zeros((count, n, width), np.int32), np.zeros((count, n, width), bool)
    padded = np.zeros((count, 3 * width + 2), np.int32)
    for i in range(n):
        at = base[:, i, None] + step
        inside = (at >= spans[:, :1]) & (at < spans[:, 1:])
        same[:, i] = inside & (text[np.clip(at, 0, len(text) - 1)] == template[i])
        above = diagonal = np.zeros((count, width), np.int32)
        if i:
            padded[:, width + 1 : 2 * width + 1] = scores[:, i - 1]
            shift = np.clip(base[:, i] - base[:, i - 1], -width, width)[:, None] + step
            above, diagonal = padded[rows, shift + width + 1], padded[rows, shift + width]
        own = np.where(inside, np.maximum(np.maximum(diagonal + np.where(same[:, i], 2, -1), above - 1), 0), 0)
        # A word of the text alone: the best of the cells to the left, less their distance.
        scores[:, i] = np.where(inside, np.maximum.accumulate(own + step, axis=1) - step, 0)
    return [trace(s, x, b) for s, x, b in zip(scores, same, base, strict=True)]


def trace(scores: np.ndarray, same: np.ndarray, base: np.ndarray) -> tuple[int, int, int, int, int, int]:
    """The alignment that ends at the first of the highest scores."""
    width, best = scores.shape[1], int(scores.max(initial=0))
    if not best:
        return 0, 0, 0, 0, 0, 0
    i, k = divmod(int(np.argmax(scores)), width)
    end_text, end_template, matches = int(base[i]) + k + 1, i + 1, 0
    while True:
        j = int(base[i]) + k
        before = j - 1 - int(base[i - 1]) if i else -1
        corner = scores[i - 1, before] if i and 0 <= before < width else 0
        if corner + (2 if same[i, k] else -1) == scores[i, k]:
            matches += int(same[i, k])
            if not corner:
                return best, matches, j, end_text, i, end_template
            i, k = i - 1, before
        elif i and 0 <= before + 1 < width and scores[i - 1, before + 1] - 1 == scores[i, k]:
            i, k = i - 1, before + 1
        else:
            k -= 1


def chains(hits: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """Hits (text place, template place) in text order, each put to the open chain whose diagonal is nearest, if one is near enough."""
    out: list[list[tuple[int, int]]] = []
    open_: list[list[tuple[int, int]]] = []
    for j, i in sorted(hits):
        open_ = [c for c in open_ if j - c[-1][0] <= GAP]
        near = [c for c in open_ if j > c[-1][0] and i > c[-1][1] and abs((j - i) - (c[-1][0] - c[-1][1])) <= BAND]
        if near:
            min(near, key=lambda c: abs((j - i) - (c[-1][0] - c[-1][1]))).append((j, i))
        else:
            open_.append([(j, i)])
            out.append(open_[-1])
    return out


def best_of(found: list[tuple[int, int, int, int, int, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """Of overlapping regions the one with the most matching words, the first of equal ones.

    Kept regions do not overlap, so only the neighbours of a place can be in the way.
    """
    kept: list[tuple[int, int, int, int, int, int]] = []
    starts: list[int] = []
    for x in sorted(found, key=lambda x: (-x[1], x[2], x[0])):
        at = bisect.bisect_left(starts, x[2])
        if (at == 0 or kept[at - 1][3] <= x[2]) and (at == len(kept) or kept[at][2] >= x[3]):
            starts.insert(at, x[2])
            kept.insert(at, x)
    return kept


def scan_text(words: np.ndarray, places: list[tuple[int, int, int]], index: Index) -> list[tuple[int, int, int, int, int, int]]:
    """(template, matches, text start, end, template start, end) for hits (template, text place, template place)."""
    out = []
    by_template = defaultdict(list)
    for t, j, i in places:
        by_template[t].append((j, i))
    for t, hits in sorted(by_template.items()):
        template, spans = index.words[t], {}
        for chain in chains(hits):
            starts = np.array([i for _, i in chain])
            along = np.array([j - i for j, i in chain])[np.maximum(np.searchsorted(starts, np.arange(len(template)), side="right") - 1, 0)]
            low, high = max(0, int(along[0]) - BAND), min(len(words), len(template) + int(along[-1]) + BAND)
            # No more can match than the two have in common, in any order.
            have = Counter(words[low:high].tolist())
            if sum(min(n, have[w]) for w, n in index.bags[t].items()) >= index.least(t):
                spans[low, high, along.tobytes()] = along
        # What lies left and right of a span is aligned again, for the band may hold the template twice.
        todo = deque((low, high, along) for (low, high, _), along in spans.items())
        while todo:
            now = [todo.popleft() for _ in range(min(CHAINS, len(todo)))]
            found = align(words, template, np.array([x[:2] for x in now]), np.stack([x[2] for x in now]))
            for (low, high, along), (_, m, a, b, c, d) in zip(now, found, strict=True):
                if index.enough(t, m, c, d):
                    out.append((t, m, a, b, c, d))
                    todo += [(x, y, along) for x, y in ((low, a), (b, high)) if y - x >= index.least(t)]
    return best_of(out)


def scan(docs: DataFrame, templates: dict[str, Template] | None = None) -> DataFrame:
    """One row for each region of a text that covers enough of a template.

    Returns doc_id, license_id, coverage (the share of the template's words that
    match), matched_words, start_word, end_word (end exclusive), start_char,
    end_char and matched_text.
    """
    id_type = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("license_id", T.StringType()), T.StructField("coverage", T.DoubleType()), *(T.StructField(n, T.LongType()) for n in ("matched_words", "start_word", "end_word", "start_char", "end_char")), T.StructField("matched_text", T.StringType())])
    chosen = templates or TEMPLATES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(chosen)
        for batch in slices(batches):
            rows, words, starts, ends = split_words(batch.column(1))
            coded = words.dictionary_encode()
            hashes = hash_strings(coded.dictionary)[coded.indices.to_numpy()] if len(words) else np.zeros(0, np.uint64)
            raw, offsets = text_bytes(batch.column(1))
            places = defaultdict(list)
            for gram in sorted(index.postings):
                at, grams = index.hits(hashes, gram)
                row = np.searchsorted(rows, at, side="right") - 1
                inside = at + gram <= rows[row + 1] if len(at) else np.zeros(0, bool)
                for j, r, g in zip(at[inside].tolist(), row[inside].tolist(), grams[inside].tolist(), strict=True):
                    places[r].extend((t, j - int(rows[r]), i) for t, i in index.postings[gram][g])
            found = []
            for r in sorted(places):
                first, data = int(rows[r]), raw[offsets[r] : offsets[r + 1]]
                regions = scan_text(hashes[first : int(rows[r + 1])], places[r], index)
                # Characters before each byte of the text, counted once for all its regions.
                chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)]) if regions else None
                for t, m, a, b, _, _ in regions:
                    x, y = int(starts[first + a] - offsets[r]), int(ends[first + b - 1] - offsets[r])
                    quote, char = bytes(data[x:y]).decode(), int(chars[x])
                    found.append((r, index.names[t], m / len(index.words[t]), m, a, b, char, char + len(quote), quote))
            if found:
                columns = list(zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(columns[0])), pa.array(columns[1]), pa.array(columns[2]), *(pa.array(c, pa.int64()) for c in columns[3:8]), pa.array(columns[8])], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.documents(spark, sf_dir))
