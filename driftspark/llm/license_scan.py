"""License texts in documents by patience alignment.

Words that are unique both in a stretch of text and in the template are anchors; their longest increasing subsequence is
kept, and the gaps between are aligned in the same way. What part of the template is aligned is its coverage.

A telling word at place j of the template that stands at place i of the text says that a copy may begin at i - j. Around each
such beginning a stretch is cut that has a third of the template's length to spare on both sides, so that of copies one after
another each has a stretch in which at least its middle occurs only once; a copy whose words are at their very places is also cut
alone. A text is read once, whole, and costs what its hits cost.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftspark.llm.common import pieces

# Public license notices, as their authors ask for them to be put in files.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "BSD-notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
}
# Words too common to point at a license.
COMMON = frozenset("a an and any are as at be by can for from in is it may must not of on or that the this to under use was with you".split())
COVERAGE = 0.8

_WORD = re.compile(r"\w+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def longest_increasing(values: list[int]) -> list[int]:
    """Indices of a longest strictly increasing subsequence (patience piles)."""
    tops, at, before = [], [], []
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        tops[k : k + 1], at[k : k + 1] = [v], [i]
        before.append(at[k - 1] if k else -1)
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def patience(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Aligned places (in a, in b), increasing in both; gaps are taken from a list, not by recursion, so length is no limit."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        na, nb = Counter(a[a0:a1]), Counter(b[b0:b1])
        where = {w: j for j, w in enumerate(b[b0:b1], b0) if nb[w] == 1}
        anchors = [(i, where[w]) for i, w in enumerate(a[a0:a1], a0) if na[w] == 1 and w in where]
        kept = [anchors[k] for k in longest_increasing([j for _, j in anchors])]
        if not kept:
            continue
        for (i0, j0), (i1, j1) in zip([(a0 - 1, b0 - 1), *kept], [*kept, (a1, b1)]):
            todo.append((i0 + 1, i1, j0 + 1, j1))
        out += kept
    return sorted(out)


class Template:
    """A license's words, where its telling words stand (all words, if none tells), and how many words may be missing."""

    def __init__(self, text: str, coverage: float):
        self.words = words_of(text)
        self.coverage = coverage
        self.missing = len(self.words) - math.ceil(coverage * len(self.words) - 1e-9)
        self.step, self.spare = max(1, len(self.words) // 6), len(self.words) // 3
        self.span = len(self.words) + 2 * self.spare
        self.places: dict[str, list[int]] = {}
        telling = set(self.words) - COMMON or set(self.words)
        for j, w in enumerate(self.words):
            if w in telling:
                self.places.setdefault(w, []).append(j)

    def stretches(self, words: list[str], hits: list[int]) -> list[tuple[int, int]]:
        """Cuts of the text, one for each ``step`` in which a copy may begin. A cut with too few different telling words is left
        out: each that is absent is a missing word at least, so it can't reach the coverage."""
        own = [i for i in hits if words[i] in self.places]
        out, least = [], max(1, len(self.places) - self.missing)
        begins = Counter(i - j for i in own for j in self.places[words[i]])
        # where so many words stand at their very places the copy is also cut without its neighbours
        sure = sum(map(len, self.places.values())) - self.missing
        out += [(max(0, b), min(len(words), b + len(self.words))) for b, n in begins.items() if n >= sure]
        for begin in sorted({b // self.step * self.step for b in begins}):
            lo, hi = max(0, begin - self.spare), min(len(words), begin + self.step + len(self.words) + self.spare)
            if len({words[i] for i in own[bisect_left(own, lo) : bisect_left(own, hi)]}) >= least:
                out.append((lo, hi))
        return out

    def within(self, pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """The most pairs, the first of such, that lie within ``span`` words of the text: no copy takes its head from one place and its tail from the next copy."""
        lo, cut = 0, (0, 0)
        for hi in range(len(pairs)):
            while pairs[hi][0] - pairs[lo][0] >= self.span:
                lo += 1
            if hi + 1 - lo > cut[1] - cut[0]:
                cut = lo, hi + 1
        return pairs[slice(*cut)]

    def find(self, words: list[str], hits: list[int]) -> list[tuple[float, int, int]]:
        """(coverage, first, last place) of the copies, each within ``span`` words. Of finds that share more than half of the shorter
        one, the best is kept: the one with the largest part of its own and the template's words aligned."""
        best, kept = set(), []
        for lo, hi in self.stretches(words, hits):
            pairs = self.within(patience(words[lo:hi], self.words))
            if len(pairs) >= len(self.words) - self.missing:
                best.add((len(pairs) / len(self.words), lo + pairs[0][0], lo + pairs[-1][0]))
        for c, i, j in sorted(best, key=lambda x: (-x[0] / (x[2] - x[1] + 1 + len(self.words)), -x[0], x[1])):
            if all(2 * (min(j, j2) - max(i, i2) + 1) <= min(j - i, j2 - i2) + 1 for _, i2, j2 in kept):
                kept.append((c, i, j))
        return kept


class Scanner:
    def __init__(self, templates: dict[str, str], coverage: float):
        self.templates = {name: Template(t, coverage) for name, t in templates.items() if words_of(t)}
        self.any = frozenset(w for t in self.templates.values() for w in t.places)

    def scan(self, text: str | None) -> list[tuple[str, float, int, int]]:
        """(license, coverage, first and last word) of the matches, by place, then name."""
        words = words_of(text) if text else []
        hits = [i for i, w in enumerate(words) if w in self.any]
        found = [(name, *x) for name, t in self.templates.items() for x in t.find(words, hits)] if hits else []
        return sorted(found, key=lambda x: (x[2], x[0]))


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """docs (doc_id, text, …) to one row per license found: doc_id, license, coverage, first_word, last_word (places of words in
    the text, from 0).

    Null and empty texts have none. A repeated row gives its rows again. A license that occurs several times is found each
    time, also in copies one after another; a copy's words lie within five thirds of the template's length. Different licenses may overlap. Very long texts are read whole. Other columns are ignored; an empty table gives no rows. No shuffle.
    """
    scanner = Scanner(templates or TEMPLATES, coverage)

    def run(batches):
        for b in pieces(batches):
            ids, rows = b.column(0).to_pylist(), []
            for i, t in zip(ids, b.column(1)):
                rows += [(i, *x) for x in scanner.scan(t.as_py())]
            cols = list(zip(*rows)) or [()] * 5
            kinds = (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "license", "coverage", "first_word", "last_word"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, license string, coverage double, first_word long, last_word long")
