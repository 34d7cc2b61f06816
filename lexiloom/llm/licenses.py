"""License scans: passages against licence templates, by Dice over word bigrams.

A passage is the whole text, a paragraph (between blank lines) or a line. It is
normalised (A-Z lower-cased, words of digits and a-z, numbers with their dots)
and held against templates by the Dice coefficient of the bags of word bigrams;
``MIN_DICE`` or more is a match. Two exact bounds prune: the sizes of two bags
with that coefficient are within t / (2 - t) of each other, and a passage that
shares so many bigrams must hold one of a template's anchor words.

With ``windows`` runs of words count as well, over line and paragraph breaks and
within lines. The best ones begin and end with a bigram of the template and hold
t / (2 - t) of its bigrams at least, so only those are tried. Of windows that
overlap, that with most of its template's bigrams counts; it is left out where a
passage that it overlaps matches the same template.

Defined cases: null text counts as empty and matches nothing; a text of one word
has no bigrams and matches nothing; of passages with equal scores the first,
longest one counts, and of templates the first in the alphabet; whole texts of
any length are scanned; repeated rows and null ids are scanned like any other;
an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Mapping
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_DICE = 0.8
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "BSD-2-Clause": "Licensed under the BSD 2-Clause License.",
    "BSD-3-Clause": "Licensed under the BSD 3-Clause License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}
_WORD = re.compile(r"[0-9]+(?:\.[0-9]+)*|[0-9a-z]+")
_BLANK = "\x20\t\n\v\f\r"
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def lowered(text: str) -> str:
    """A-Z in lower case; no other letter changes."""
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).decode("utf-8", "surrogatepass")


def bigrams(text: str) -> Counter:
    words = _WORD.findall(lowered(text))
    return Counter(zip(words, words[1:], strict=False))


def dice(a: Counter, b: Counter) -> float:
    total = a.total() + b.total()
    return 2 * (a & b).total() / total if total else 0.0


def passages(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the whole text, its paragraphs and its lines, each once, longest first from each start."""
    seen = {(0, len(text))}
    at, begin, end = 0, None, 0
    for line in text.split("\n"):
        if line.strip(_BLANK):
            begin, end = at if begin is None else begin, at + len(line)
            seen.add((at, end))
        elif begin is not None:
            seen.add((begin, end))
            begin = None
        at += len(line) + 1
    if begin is not None:
        seen.add((begin, end))
    yield from sorted(seen, key=lambda s: (s[0], -s[1]))


class Scanner:
    """Templates with their bags, ordered by size, and anchor words."""

    def __init__(self, templates: Mapping[str, str], least: float):
        self.least = Fraction(str(least))
        self.bags = sorted(((n, bigrams(t)) for n, t in templates.items()), key=lambda x: x[0])
        self.holders: dict[tuple[str, str], list[int]] = {}
        for t, (_, bag) in enumerate(self.bags):
            for pair in bag:
                self.holders.setdefault(pair, []).append(t)
        self.anchors = sorted({a for _, bag in self.bags for a in self._anchors(bag)})
        self.found = re.compile("|".join(map(re.escape, self.anchors))) if self.anchors else None

    def _anchors(self, bag: Counter) -> list[str]:
        """Longest words of which a passage with the least coefficient holds at least one."""
        n = bag.total()
        missing = n - math.ceil(n * self.least / (2 - self.least))
        chosen: list[str] = []
        for word in sorted({w for pair in bag for w in pair}, key=lambda w: (-len(w), w)):
            if sum(k for pair, k in bag.items() if set(pair) & set(chosen)) > missing:
                break
            chosen.append(word)
        return chosen

    def _windows(self, low: str) -> list[tuple[int, float, int, int, str]]:
        """(-shared bigrams, -score, start, end, template) of the best window from each start that matches."""
        words = list(_WORD.finditer(low))
        pairs = [(a[0], b[0]) for a, b in zip(words, words[1:], strict=False)]
        hits: dict[int, list[int]] = {}
        for k, pair in enumerate(pairs):
            for t in self.holders.get(pair, ()):
                hits.setdefault(t, []).append(k)
        out = []
        for t, at in hits.items():
            name, bag = self.bags[t]
            m = bag.total()
            needed, longest = math.ceil(m * self.least / (2 - self.least)), math.floor(m * (2 - self.least) / self.least)
            for i, first in enumerate(at):
                # so many hits within the longest window, or none from here can match
                if i + needed > len(at) or at[i + needed - 1] - first >= longest:
                    continue
                left, shared, best = bag.copy(), 0, None
                for last in at[i:]:
                    n = last - first + 1
                    if n > longest:
                        break
                    if left[pairs[last]] > 0:
                        left[pairs[last]] -= 1
                        shared += 1
                        score = 2 * shared / (n + m)
                        if score >= self.least and (best is None or score > best[1]):
                            best = (shared, score, last)
                if best:
                    out.append((-best[0], -best[1], words[first].start(), words[best[2] + 1].end(), name))
        return out

    def with_windows(self, text: str | None) -> list[tuple[float, int, int, str]]:
        """``matches``, and those of windows, by start, longest first."""
        out = self.matches(text)
        low = lowered(text or "")
        if not any(a in low for a in self.anchors):
            return out
        taken: list[tuple[int, int]] = []
        told = list(out)
        for _, score, start, end, name in sorted(self._windows(low)):
            if any(a < end and start < b for a, b in taken):
                continue
            taken.append((start, end))
            if not any(n == name and a < end and start < b for _, a, b, n in told):
                out.append((-score, start, end, name))
        return sorted(out, key=lambda x: (x[1], -x[2], x[3]))

    def matches(self, text: str | None) -> list[tuple[float, int, int, str]]:
        """(score, start, end, template) of each passage that matches, its best template only."""
        low = lowered(text or "")
        if not any(a in low for a in self.anchors):
            return []
        out = []
        for start, end in passages(low):
            if not self.found.search(low, start, end):
                continue
            bag = bigrams(low[start:end])
            n, best = bag.total(), None
            for name, other in self.bags:
                m = other.total()
                if self.least * max(n, m) > (2 - self.least) * min(n, m):
                    continue
                score = dice(bag, other)
                if score >= self.least and (best is None or score > best[0]):
                    best = (score, start, end, name)
            if best:
                out.append(best)
        return out


def scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, least: float = MIN_DICE, id_col: str = "doc_id", text_col: str = "text", windows: bool = False) -> DataFrame:
    """(doc_id, license, dice, n_matches, matches) of every row.

    ``license`` and ``dice`` are of the best match, null where there is none;
    ``matches`` is template:start:end by start, comma-joined, in code points.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = rows.select("doc_id").schema.add("license", "string").add("dice", "double").add("n_matches", "long").add("matches", "string")
    held: dict[str, Scanner] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = held.setdefault("", Scanner(templates, least))
        for batch in batches:
            told = [scanner.with_windows(t.as_py()) if windows else scanner.matches(t.as_py()) for t in batch.column(1)]
            best = [max(m, key=lambda x: (x[0], -x[1], x[2])) if m else None for m in told]
            columns = [
                batch.column(0),
                pa.array([b and b[3] for b in best], pa.string()),
                pa.array([b and round(b[0], 6) for b in best], pa.float64()),
                pa.array([len(m) for m in told], pa.int64()),
                pa.array([",".join(f"{n}:{a}:{b}" for _, a, b, n in m) for m in told], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return rows.mapInArrow(run, schema)
