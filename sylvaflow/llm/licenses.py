"""Licence scans by patience alignment of a text with templates.

Words shared by a template and a text are counted first: a stretch can only cover `least` of a template
if it holds that many of its words, so most texts are done after one vectorised look-up. Of the others,
stretches of up to STRETCH template lengths around the template's words are aligned: words that are
unique in both are anchors, the longest increasing run of anchors stays, and the gaps between them are
aligned in the same way; runs of equal words at a gap's ends are taken first. Coverage is the share of
the template's words that are aligned.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sylvaflow.llm.text import Words, as_strings, by_bytes

# Wording of public licences and of the notices that refer to them.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ),
    "MIT": (
        "Released under the MIT License",
        "Licensed under the MIT License",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2",),
    "BSD-3-Clause": (
        "Licensed under the BSD 3-Clause License",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    ),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0",),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "Proprietary": ("All rights reserved",),
}
#: A stretch is so many times as long as its template at most.
STRETCH = 1.5
#: Templates, in words together, up to which they may go to the tasks.
MOST_WORDS = 1_000_000
#: Characters at a word's ends that don't count.
EDGE = ".,;:!?\"'()[]*#$%&|"
FOUND = "doc_id long, license string, coverage double, start_word long, end_word long, n_aligned long"


def _plain(word: str) -> str:
    return word.strip(EDGE)


def aligned(a: list, b: list) -> list[tuple[int, int]]:
    """Pairs of equal entries of a and b in order, by patience alignment."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, m, j, n = todo.pop()
        while i < m and j < n and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1] == b[n - 1]:
            m, n = m - 1, n - 1
            out.append((m, n))
        if i >= m or j >= n:
            continue
        mine, theirs = Counter(a[i:m]), Counter(b[j:n])
        at = {w: k for k, w in enumerate(b[j:n], j) if theirs[w] == 1}
        anchors = [(k, at[w]) for k, w in enumerate(a[i:m], i) if mine[w] == 1 and w in at]
        run = _increasing(anchors)
        if not run:
            continue
        for (p, q), (s, t) in zip([(i - 1, j - 1), *run], [*run, (m, n)]):
            todo.append((p + 1, s, q + 1, t))
        out.extend(run)
    return sorted(out)


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest run of pairs, ascending in the first, that ascends in the second."""
    tops: list[int] = []
    last: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, q) in enumerate(pairs):
        pile = bisect_left(tops, q)
        back[k] = last[pile - 1] if pile else -1
        tops[pile : pile + 1], last[pile : pile + 1] = [q], [k]
    out = []
    k = last[-1] if last else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


class Scanner:
    """Templates as word hashes."""

    def __init__(self, templates: dict[str, tuple[str, ...]]):
        pairs = [(name, " ".join(filter(None, map(_plain, t.split())))) for name, texts in templates.items() for t in texts]
        words = Words(pa.array([t for _, t in pairs], pa.string()))
        self.names = [n for n, _ in pairs]
        self.words = [words.hash[a:b] for a, b in zip(words.first[:-1], words.first[1:])]
        self.known = np.unique(words.hash)
        #: how often each template has each known word
        self.wants = np.zeros((len(self.words), len(self.known)), np.int64)
        for wants, template in zip(self.wants, self.words):
            np.add.at(wants, np.searchsorted(self.known, template), 1)
        self.edge = np.zeros(256, bool)
        self.edge[list(EDGE.encode())] = True

    def _hashes(self, words: Words) -> np.ndarray:
        """Hashes of the words without EDGE characters; 0 for words of nothing else."""
        start, end = words.start.copy(), words.end.copy()
        while len(start):
            more = (start < end) & self.edge[words.data[np.minimum(start, len(words.data) - 1)]]
            if not more.any():
                break
            start += more
        while len(start):
            more = (start < end) & self.edge[words.data[end - 1]]
            if not more.any():
                break
            end -= more
        return np.where(start < end, words.spans(start, np.maximum(start, end)), np.uint64(0))

    def scan(self, column: pa.Array, least: float) -> list[tuple[int, str, float, int, int, int]]:
        """(row, licence, coverage, first word, end word, aligned words) of each covered stretch. Of stretches
        that overlap, the one with more aligned words stays, then that of higher coverage, then the first."""
        words = Words(column)
        hashes = self._hashes(words)
        spot = np.minimum(np.searchsorted(self.known, hashes), max(len(self.known) - 1, 0))
        hit = np.flatnonzero(self.known[spot] == hashes) if len(self.known) else np.zeros(0, np.int64)
        row_of = np.searchsorted(words.first, hit, side="right") - 1
        code = spot[hit]
        n, k = len(words.first) - 1, max(len(self.known), 1)
        pair, have = np.unique(row_of * k + code, return_counts=True)
        out = []
        for name, template, wants in zip(self.names, self.words, self.wants):
            need = int(np.ceil(least * len(template) - 1e-9))
            if not need:
                continue
            shared = np.bincount(pair // k, np.minimum(have, wants[pair % k]), minlength=n)
            for row in np.flatnonzero(shared >= need):
                own = slice(*np.searchsorted(hit, words.first[row : row + 2]))
                at = hit[own][wants[code[own]] > 0]
                out.extend((int(row), name, *x) for x in self._stretches(hashes, at, int(words.first[row]), template, need))
        best: list[tuple] = []
        taken: set[tuple[int, int]] = set()
        for x in sorted(out, key=lambda x: (x[0], -x[5], -x[2], x[3], x[1])):
            own = [(x[0], word) for word in range(x[3], x[4])]
            if taken.isdisjoint(own):
                taken.update(own)
                best.append(x)
        return best

    @staticmethod
    def _stretches(hashes: np.ndarray, at: np.ndarray, first: int, template: np.ndarray, need: int) -> Iterator[tuple[float, int, int, int]]:
        width = int(np.ceil(STRETCH * len(template)))
        end = np.searchsorted(at, at + width)
        dense = np.flatnonzero(end - np.arange(len(at)) >= need)
        goal = template.tolist()
        k = 0
        while k < len(dense):
            i = dense[k]
            # of the starts whose stretches overlap this one, the one that holds most distinct words of the template
            stop = np.searchsorted(at[dense], at[i] + len(template) // 2 + 1)
            starts = dense[k:stop]
            start = max(starts, key=lambda s: (len(set(hashes[at[s : end[s]]].tolist())), -s)) if len(starts) > 1 else i
            begin, close = int(at[start]), int(at[end[start] - 1]) + 1
            pairs = aligned(goal, hashes[begin:close].tolist())
            if len(pairs) >= need:
                last = begin + pairs[-1][1] + 1
                yield len(pairs) / len(goal), begin + pairs[0][1] - first, last - first, len(pairs)
                k = int(np.searchsorted(at[dense], last))
            else:
                k = max(int(np.searchsorted(dense, start, side="right")), k + 1)


def license_scan(docs: DataFrame, templates: dict[str, tuple[str, ...]] | None = None, least: float = 0.9) -> DataFrame:
    """doc_id, license, coverage, start_word, end_word, n_aligned of every stretch of docs(doc_id, text) that
    covers `least` or more of a template's words. Of overlapping stretches the one with more aligned words counts.

    Words are lower-cased (A-Z) and lose punctuation at their ends. Null, empty and wordless texts have no
    row; a row without doc_id keeps a null; repeated rows are found each; an empty table or no templates
    give an empty result; other columns are ignored. Texts are read where they are, without a shuffle.
    """
    chosen = TEMPLATES if templates is None else templates
    if sum(len(t.split()) for texts in chosen.values() for t in texts) > MOST_WORDS:
        raise ValueError(f"templates of over {MOST_WORDS} words: scan with parts of them")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(chosen)
        for batch in batches:
            for part in by_bytes(batch, "text"):
                got = scanner.scan(as_strings(part.column("text")), least)
                rows = pa.array([g[0] for g in got], pa.int64())
                kinds = (pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()).take(rows), *(pa.array([g[i + 1] for g in got], k) for i, k in enumerate(kinds))],
                    ["doc_id", "license", "coverage", "start_word", "end_word", "n_aligned"],
                )

    return docs.select("doc_id", "text").mapInArrow(scan, FOUND)
