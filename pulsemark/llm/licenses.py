"""License scan: winnowed fingerprints of templates, then banded alignment.

Templates are cut into word k-grams and winnowed: of every WINDOW neighbouring k-gram hashes the smallest is a
fingerprint, so that any common run of K + WINDOW - 1 words shares one. An inverted index leads from fingerprint to
(template, position). A document's own winnowed fingerprints pick candidate templates and diagonals; where changed
words leave no common run, places whose words alone could cover enough of a template are candidates too. Each
candidate is then aligned word by word within a band around its diagonal, and again in what lies outside the span
found, until no seed is left, so that copies side by side are told apart. A match reports how much of the template
it covers and where it stands in the text.

One pass over the documents without a shuffle; the index holds a few thousand numbers, fixed by the templates.

Edge cases: null and wordless texts match nothing; repeated rows give repeated matches; a match inside a longer match
of another template is dropped, ties go to the template first by name; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsemark.llm.common import mix, sliced

K = 3
WINDOW = 3
BAND = 12
COVERAGE = 0.8
_WORD = re.compile(r"[^\W_]+")
_STEP = np.uint64(0x9E3779B97F4A7C15)

# fixed values: public license notices
TEMPLATES = {
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
        with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
        applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
        WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
        permissions and limitations under the License.""",
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
        the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this
        list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.""",
    "BSL-1.0": """Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at
        https://www.boost.org/LICENSE_1_0.txt)""",
    "CC-BY-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0-line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
        This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty
        of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
        provided that the above copyright notice and this permission notice appear in all copies.""",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
        files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy,
        modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software
        is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be
        included in all copies or substantial portions of the Software.""",
    "MIT-line": "Released under the MIT License.",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish,
        use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
        commercial or non-commercial, and by any means.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable
        for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose,
        including commercial applications, and to alter it and redistribute it freely""",
}


def word_hashes(text: str) -> np.ndarray:
    words = _WORD.findall(_lowered(text))
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w) for w in words), np.uint64, len(words))


def grams(words: np.ndarray) -> np.ndarray:
    n = len(words) - K + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(K):
        out *= _STEP
        out += words[k : k + n]
    return mix(out)


def winnow(hashes: np.ndarray) -> np.ndarray:
    """Positions of the fingerprints: the last smallest hash of every window."""
    if len(hashes) <= WINDOW:
        return np.array([len(hashes) - 1 - int(hashes[::-1].argmin())]) if len(hashes) else np.zeros(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(hashes, WINDOW)[:, ::-1]
    return np.unique(np.arange(len(views)) + WINDOW - 1 - views.argmin(axis=1))


class Index:
    """Inverted index of the templates' fingerprints."""

    def __init__(self, templates: dict[str, str]):
        self.names = sorted(templates)
        self.words = [word_hashes(templates[n]) for n in self.names]
        rows = []
        for t, words in enumerate(self.words):
            found = grams(words)
            rows += [(int(found[p]), t, int(p)) for p in winnow(found)]
        rows.sort()
        self.keys = np.array([r[0] for r in rows], np.uint64)
        self.at = [(r[1], r[2]) for r in rows]
        # the templates' distinct words, each template as their numbers, and how often it has each
        self.vocabulary = np.unique(np.concatenate([*self.words, np.zeros(0, np.uint64)]))
        self.codes = [np.searchsorted(self.vocabulary, w) for w in self.words]
        self.counts = np.array([np.bincount(c, minlength=len(self.vocabulary)) for c in self.codes]).reshape(len(self.words), -1)


@lru_cache(maxsize=1)
def default_index() -> Index:
    return Index(TEMPLATES)


def align(doc: np.ndarray, template: np.ndarray, diagonal: int, low: int, high: int) -> tuple[int, int, int]:
    """(matched words, first, last + 1) of the best local alignment of doc[low:high] near ``diagonal`` = doc - template.

    Match 2, mismatch and gap -1. Each cell keeps its score, its matches and where it began.
    """
    none = (0, 0, -1)
    best = (0, 0, 0, 0)
    above: dict[int, tuple[int, int, int]] = {}
    for i in range(len(template)):
        row: dict[int, tuple[int, int, int]] = {}
        middle = i + diagonal
        left = none
        for j in range(max(low, middle - BAND), min(high, middle + BAND + 1)):
            s, m, b = above.get(j - 1, none)
            if template[i] == doc[j]:
                cell = (s + 2, m + 1, j if b < 0 else b)
            else:
                cell = (s - 1, m, b)
            up = above.get(j, none)
            if up[0] - 1 > cell[0]:
                cell = (up[0] - 1, up[1], up[2])
            if left[0] - 1 > cell[0]:
                cell = (left[0] - 1, left[1], left[2])
            if cell[0] <= 0:
                cell = none
            else:
                row[j] = cell
                if (cell[0], cell[1]) > best[:2]:
                    best = (cell[0], cell[1], cell[2], j + 1)
            left = cell
        above = row
    return best[1], best[2], best[3]


def _by_words(words: np.ndarray, index: Index, coverage: float) -> Iterator[tuple[int, int, int]]:
    """(template, diagonal, position) where the words from position on, in any order, could cover enough of a template.

    The first matched word of an alignment is one of the template's first words, as few can be missing.
    """
    if not len(words) or not len(index.vocabulary):
        return
    codes = np.minimum(np.searchsorted(index.vocabulary, words), len(index.vocabulary) - 1)
    spots = np.flatnonzero(index.vocabulary[codes] == words)
    codes = codes[spots]
    size = len(index.vocabulary)
    most = np.minimum(index.counts, np.bincount(codes, minlength=size)).sum(axis=1)
    for t, own in enumerate(index.codes):
        need = coverage * len(own)
        if most[t] < need:
            continue
        fits: dict[int, bool] = {}
        for i in range(int(len(own) - need) + 1):
            for at in np.flatnonzero(codes == own[i]).tolist():
                if at not in fits:
                    end = np.searchsorted(spots, spots[at] + len(own) + BAND)
                    near = np.bincount(codes[at:end], minlength=size)
                    fits[at] = np.minimum(index.counts[t], near).sum() >= need
                if fits[at]:
                    yield t, int(spots[at]) - i, int(spots[at])


def _copies(words: np.ndarray, template: np.ndarray, hits: list[tuple[int, int]], coverage: float) -> Iterator[tuple[int, int, int]]:
    """(matched words, first, last + 1) of the copies of a template, from its seeds (diagonal, position)."""
    judged = np.zeros(len(words), bool)  # words of copies found, and of spans this candidate has tried
    k = 0
    while k < len(hits):
        # seeds on nearby diagonals belong to one candidate
        e = k
        while e + 1 < len(hits) and hits[e + 1][0] - hits[k][0] <= BAND:
            e += 1
        left = [h for h in hits[k : e + 1] if not judged[h[1]]]
        failed: list[tuple[int, int]] = []
        while left:
            diagonal, spot = left[len(left) // 2]
            low, high = max(0, diagonal - BAND), min(len(words), diagonal + len(template) + BAND)
            before, after = np.flatnonzero(judged[low:spot]), np.flatnonzero(judged[spot:high])
            low, high = low + int(before[-1]) + 1 if len(before) else low, spot + int(after[0]) if len(after) else high
            matched, a, b = align(words, template, diagonal, low, high)
            if b == a:
                left.remove((diagonal, spot))
                continue
            judged[a:b] = True
            left = [h for h in left if not judged[h[1]]]
            if matched >= coverage * len(template):
                yield matched, a, b
            else:
                failed.append((a, b))
        for a, b in failed:
            judged[a:b] = False
        k = e + 1


def scan(text: str | None, index: Index, coverage: float = COVERAGE) -> list[tuple[str, float, int, int, int]]:
    """(template, coverage, matched words, start, end) of every match, positions in code points."""
    if not text:
        return []
    words = word_hashes(text)
    found = grams(words)
    picks = winnow(found)
    values = found[picks]
    first = np.searchsorted(index.keys, values, "left")
    last = np.searchsorted(index.keys, values, "right")
    seeds: dict[int, set[tuple[int, int]]] = {}
    for n in np.flatnonzero(last > first):
        for r in range(first[n], last[n]):
            t, p = index.at[r]
            seeds.setdefault(t, set()).add((int(picks[n]) - p, int(picks[n])))
    for t, diagonal, spot in _by_words(words, index, coverage):
        seeds.setdefault(t, set()).add((diagonal, spot))
    matches = []
    for t, hits in seeds.items():
        template = index.words[t]
        for matched, a, b in _copies(words, template, sorted(hits), coverage):
            matches.append((matched, index.names[t], matched / len(template), a, b))
    if not matches:
        return []
    matches.sort(key=lambda m: (-m[0], m[1], m[3]))
    kept: list[tuple[int, str, float, int, int]] = []
    free = np.ones(len(words), bool)
    for m in matches:
        if free[m[3] : m[4]].all():
            free[m[3] : m[4]] = False
            kept.append(m)
    spots = [(w.start(), w.end()) for w in _WORD.finditer(_lowered(text))]
    return sorted(((n, c, m, spots[a][0], spots[b - 1][1]) for m, n, c, a, b in kept), key=lambda r: (r[3], r[0]))


def _lowered(text: str) -> str:
    """Lower case where that keeps positions; the few letters whose lower case is longer stay as they are."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def find(docs: DataFrame, index: Index | None = None, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, template, coverage, matched_words, start, end: one row per match."""
    chosen = index or default_index()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = [(doc, *m) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)) for m in scan(text.as_py(), chosen, coverage)]
            columns = list(zip(*rows)) or [()] * 6
            types = [pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], ["doc_id", "template", "coverage", "matched_words", "start", "end"]
            )

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id long, template string, coverage double, matched_words long, start long, end long")
