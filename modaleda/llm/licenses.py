"""License notices in documents by patience alignment.

A template and a stretch of text are aligned on the words that are unique in both:
the longest increasing subsequence of these anchors is kept, the stretches between
them are aligned in the same way, and stretches without anchors are matched from
their ends.  Coverage is the share of the template's words that are aligned.

A document can only cover the share ``coverage`` of a template of m words if it has
one of its rarest m - ceil(coverage * m) + 1 words, so texts with none of these
are skipped, which is exact, and alignment is tried around them alone.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W_]+(?:[.\-][^\W_]+)*")

TEMPLATES: dict[str, str] = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    "MIT": "Released under the MIT License.",
    "MIT-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
    "BSD-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "all-rights": "All rights reserved.",
    # other wordings: a short notice may not miss a word, as without its name any other license would do
    "Apache-2.0-short": "under the Apache License 2.0",
    "MIT-short": "under the MIT License",
    "MIT-title": "The MIT License (MIT)",
    "GPL-3.0-short": "under the GNU General Public License v3",
    "GPL-3.0-version": "under the GNU General Public License version 3",
    "CC-BY-NC-4.0-short": "CC BY-NC 4.0",
    "CC-BY-SA-4.0-short": "CC BY-SA 4.0",
    "CC-BY-4.0-short": "CC BY 4.0",
    "CC-BY-NC-4.0-name": "Creative Commons Attribution-NonCommercial 4.0 International",
    "CC-BY-SA-4.0-name": "Creative Commons Attribution-ShareAlike 4.0 International",
    "CC-BY-4.0-name": "Creative Commons Attribution 4.0 International",
    # identifiers of source files
    "Apache-2.0-SPDX": "SPDX-License-Identifier: Apache-2.0",
    "MIT-SPDX": "SPDX-License-Identifier: MIT",
    "GPL-3.0-SPDX": "SPDX-License-Identifier: GPL-3.0-only",
    "GPL-3.0-or-later-SPDX": "SPDX-License-Identifier: GPL-3.0-or-later",
    "GPL-2.0-SPDX": "SPDX-License-Identifier: GPL-2.0",
    "LGPL-2.1-SPDX": "SPDX-License-Identifier: LGPL-2.1",
    "BSD-3-SPDX": "SPDX-License-Identifier: BSD-3-Clause",
    "BSD-2-SPDX": "SPDX-License-Identifier: BSD-2-Clause",
    "MPL-2.0-SPDX": "SPDX-License-Identifier: MPL-2.0",
    "ISC-SPDX": "SPDX-License-Identifier: ISC",
    "CC-BY-4.0-SPDX": "SPDX-License-Identifier: CC-BY-4.0",
    "Unlicense-SPDX": "SPDX-License-Identifier: Unlicense",
    # fuller texts
    "Apache-2.0-text": """Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
        WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "MIT-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"),
        to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense,
        and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
        FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY,
        WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "GPL-3.0-text": """This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
        See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program.""",
    "BSD-text": """Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.""",
    "ISC-text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.""",
}
COMMON = frozenset("a an and any are as at be by can either for free from in is it may no not of on or other person source that the this to under use version with without work you".split())

PAIRS = 20


def tokens(text: str) -> list[str]:
    return [w.lower() for w in WORD.findall(text)]


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence of pairs (sorted by their first) whose seconds rise."""
    tails: list[int] = []
    at: list[int] = []
    back = [-1] * len(pairs)
    for i, (_, b) in enumerate(pairs):
        k = bisect.bisect_left(tails, b)
        if k == len(tails):
            tails.append(b), at.append(i)
        else:
            tails[k], at[k] = b, i
        back[i] = at[k - 1] if k else -1
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def align(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """Aligned (text, template) positions."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(text), 0, len(template))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and text[a] == template[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a == b or c == d:
            continue
        n_text, n_template = Counter(text[a:b]), Counter(template[c:d])
        where = {w: j for j, w in enumerate(template[c:d], c) if n_template[w] == 1}
        anchors = _increasing([(i, where[w]) for i, w in enumerate(text[a:b], a) if n_text[w] == 1 and w in where])
        if not anchors:
            continue
        out += anchors
        for (i, j), (i2, j2) in zip([(a - 1, c - 1), *anchors], [*anchors, (b, d)]):
            if i2 - i > 1 and j2 - j > 1:
                todo.append((i + 1, i2, j + 1, j2))
    return sorted(out)


def any_of(words: list[str]) -> str:
    """A pattern of all words, common beginnings once, so that a text is not held against each word in turn."""
    tree: dict = {}
    for w in words:
        node = tree
        for c in w:
            node = node.setdefault(c, {})
        node[""] = {}

    def pattern(node: dict) -> str:
        parts = [re.escape(c) + pattern(n) for c, n in sorted(node.items()) if c]
        if not parts:
            return ""
        ends = "" in node
        return ("(?:" + "|".join(parts) + ")" if ends or len(parts) > 1 else parts[0]) + "?" * ends

    return pattern(tree)


class Scanner:
    def __init__(self, templates: dict[str, str], coverage: float, stretch: float):
        self.coverage, self.stretch = coverage, stretch
        self.templates = {name: tokens(t) for name, t in templates.items()}
        self.words = {name: frozenset(t) for name, t in self.templates.items()}
        spread = Counter(w for t in self.templates.values() for w in set(t))
        self.keys: dict[str, dict[str, list[int]]] = {}
        for name, t in self.templates.items():
            rare = sorted(range(len(t)), key=lambda i: (t[i] in COMMON, spread[t[i]], -len(t[i]), i))
            need = len(t) - math.ceil(coverage * len(t) - 1e-9) + 1
            for i in rare[:need]:
                self.keys.setdefault(t[i], {}).setdefault(name, []).append(i)
        self.any_key = r"(?iu)(?<![\p{L}\p{N}])(?:" + any_of(sorted(self.keys)) + r")(?![\p{L}\p{N}])"

    def fit(self, words: list[str], lo: int, hi: int, template: list[str]) -> tuple[float, int, int] | None:
        """(coverage, first word, word after the last) of the alignment in a window, if it covers enough in a short enough stretch."""
        matched = align(words[lo:hi], template)
        share = len(matched) / len(template)
        if not matched or share < self.coverage - 1e-9:
            return None
        first, end = lo + matched[0][0], lo + matched[-1][0] + 1
        return (share, first, end) if end - first <= self.stretch * len(template) + 1e-9 else None

    def tighter(self, words: list[str], lo: int, hi: int, template: list[str], least: int) -> tuple[float, int, int] | None:
        """The best fit in windows from and to each place where a stretch that covers enough can begin and end.

        In the whole window a stray word at its edge can be taken for the template's end, or one
        that comes again can stop being an anchor.  All pairs of ends are tried for templates of up
        to PAIRS words; a longer one is tried from each beginning, and to each end, at full length.
        """
        spare, most = len(template) - least, math.floor(self.stretch * len(template) + 1e-9)
        heads, tails = set(template[: spare + 1]), set(template[least - 1 :])
        begins = [i for i in range(lo, hi) if words[i] in heads]
        ends = [i + 1 for i in range(lo, hi) if words[i] in tails]
        if len(template) <= PAIRS:
            windows = [(i, j) for i in begins for j in ends if least <= j - i <= most]
        else:
            windows = [(i, min(hi, i + most)) for i in begins] + [(max(lo, j - most), j) for j in ends]
        hits = [h for i, j in windows if (h := self.fit(words, i, j, template))]
        return max(hits, key=lambda h: (h[0], -h[1], -h[2]), default=None)

    def scan(self, text: str) -> list[tuple[str, float, int, int]]:
        """(license, coverage, first word, word after the last) of the best stretch for each license, the earliest of the best."""
        words = tokens(text)
        starts: dict[str, set[int]] = {}
        for p, w in enumerate(words):
            for name, offsets in self.keys.get(w, {}).items():
                starts.setdefault(name, set()).update(p - o for o in offsets)
        out = []
        for name, candidates in starts.items():
            template = self.templates[name]
            slack = math.ceil(len(template) * (self.stretch - 1))
            best = None
            wanted, least = self.words[name], math.ceil(self.coverage * len(template) - 1e-9)
            for s in sorted(candidates):
                lo, hi = max(0, s - slack), min(len(words), s + len(template) + slack)
                if sum(w in wanted for w in words[lo:hi]) < least:
                    continue
                hit = self.fit(words, lo, hi, template) or self.tighter(words, lo, hi, template, least)
                if hit and (best is None or hit[0] > best[1] + 1e-12):
                    best = (name, *hit)
            if best:
                out.append(best)
        return sorted(out)


def _emit(templates: dict[str, str], coverage: float, stretch: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, coverage, stretch)
        for b in batches:
            rows, found = [], []
            for i, text in enumerate(b.column(1)):
                for hit in scanner.scan(text.as_py()):
                    rows.append(i), found.append(hit)
            if rows:
                name, share, first, end = zip(*found)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(rows)), pa.array(name), pa.array(share), pa.array(first, pa.int64()), pa.array(end, pa.int64())], ["doc_id", "license", "coverage", "first_word", "end_word"]
                )

    return run


def license_scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, coverage: float = 0.9, stretch: float = 1.5) -> DataFrame:
    """(doc_id, license, coverage, first_word, end_word): notices that cover the given share of a template within ``stretch`` times its length.

    docs needs doc_id and text, which is read whole, however long.  A row comes back once for each license that it has, with
    its best stretch of words [first_word, end_word), the earliest of equals.  Null and
    empty texts have none; null ids and repeated rows are kept as they are; other columns
    are ignored; an empty table gives an empty result.
    """
    key = Scanner(templates, coverage, stretch).any_key
    kind = docs.schema["doc_id"].dataType.simpleString()
    slim = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(F.col("text").rlike(key))
    return slim.mapInArrow(_emit(templates, coverage, stretch), f"doc_id {kind}, license string, coverage double, first_word long, end_word long")
