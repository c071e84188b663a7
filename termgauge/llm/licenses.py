"""License notices found in texts by patience alignment with templates.

The words (letters and digits, lower case) of a template and of a region of a text are aligned:
words that are unique on both sides are anchors, the longest increasing subsequence of their places
keeps those in order, and the gaps before, between and after them are aligned the same way. A gap
without anchors is aligned by a longest common subsequence, which bounds nothing away since gaps
are no longer than the region. Of the aligned places the run that counts most is taken, a place as
one and a word between places that is not aligned as minus a half, so far-off chance matches fall
away. Coverage is that of both sides: aligned words by the larger of the template's words and the
words from the first to the last place. Words put into a notice count as much as words left out.

Templates of fewer than ``SHORT`` words must be met whole, for one word is all that separates short
notices of different licences. Of notices that overlap, of whatever template, the one with the most
aligned words times coverage stays: ``CC BY-NC 4.0`` is no ``CC BY 4.0``, the Lesser licence not the
General one. The text of a licence is found by the words of its grant, its whole text included.

Regions are found at the template's rare words (those that few other templates have): a notice with
enough coverage is no longer than the template by its coverage, and a region holds all notices that
begin in its first half. A text is read whole, and each notice in it has its own region, so a
repeated notice does not spoil the uniqueness of its words.

Defined results: NULL, empty and blank texts have no notices; a text may have several; of equal
regions the first counts and overlapping regions give the best; repeated rows each have theirs; an
empty table gives no rows; very long texts take memory by their words, regions one by one; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COVERAGE = 0.8
SHORT = 20  # words
FOUND = "doc_id bigint, license string, start_word bigint, end_word bigint, matched bigint, template_words bigint, coverage double"

# Texts of public licence notices (fixed values).
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License."
    ),
    "mit": "Released under the MIT License.",
    "mit-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of "
        "the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software."
    ),
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version."
    ),
    "gpl-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-2.0-header": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your "
        "option) any later version."
    ),
    "lgpl-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "lgpl-3.0-header": (
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at "
        "your option) any later version."
    ),
    "lgpl-2.1-header": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
        "General Public License as published by the Free Software Foundation; either version 2.1 of the License, or "
        "(at your option) any later version."
    ),
    "agpl-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "agpl-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at "
        "your option) any later version."
    ),
    "bsd-2-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, "
        "this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the "
        "above copyright notice, this list of conditions and the following disclaimer in the documentation and/or "
        "other materials provided with the distribution."
    ),
    "bsd-3-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, "
        "this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the "
        "above copyright notice, this list of conditions and the following disclaimer in the documentation and/or "
        "other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of "
        "its contributors may be used to endorse or promote products derived from this software without specific "
        "prior written permission."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
        "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, "
        "for any purpose, commercial or non-commercial, and by any means."
    ),
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "cc-by-nd-4.0": "Licensed under CC BY-ND 4.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-nc-sa-4.0": "Licensed under CC BY-NC-SA 4.0.",
    "cc-by-nc-nd-4.0": "Licensed under CC BY-NC-ND 4.0.",
}

WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, sorted by the first number, whose second numbers increase."""
    tails: list[int] = []
    at: list[int] = []
    before: list[int] = []
    for i, (_, b) in enumerate(pairs):
        p = bisect_left(tails, b)
        before.append(at[p - 1] if p else -1)
        if p == len(tails):
            tails.append(b), at.append(i)
        else:
            tails[p], at[p] = b, i
    kept, i = [], at[-1] if at else -1
    while i >= 0:
        kept.append(pairs[i])
        i = before[i]
    return kept[::-1]


def _common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence."""
    rows = [[0] * (len(b) + 1)]
    for x in a:
        last, row = rows[-1], [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
        rows.append(row)
    out, i, j = [], len(a), len(b)
    while i and j:
        if a[i - 1] == b[j - 1]:
            out.append((i - 1, j - 1))
            i, j = i - 1, j - 1
        elif rows[i - 1][j] >= rows[i][j - 1]:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def align(template: list[str], text: list[str]) -> list[tuple[int, int]]:
    """Aligned places of the two, increasing on both sides."""
    out, stack = [], [(0, len(template), 0, len(text))]
    while stack:
        a, b, c, d = stack.pop()
        if a >= b or c >= d:
            continue
        left, right = Counter(template[a:b]), Counter(text[c:d])
        place = {w: j for j, w in enumerate(text[c:d], c)}
        unique = [(i, place[w]) for i, w in enumerate(template[a:b], a) if left[w] == 1 and right.get(w) == 1]
        anchors = _increasing(unique)
        if not anchors:
            out += [(a + i, c + j) for i, j in _common(template[a:b], text[c:d])]
            continue
        out += anchors
        i0, j0 = a, c
        for i, j in [*anchors, (b, d)]:
            stack.append((i0, i, j0, j))
            i0, j0 = i + 1, j + 1
    return sorted(out)


def strongest(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The run of aligned places with the largest number of places less half the text words between them."""
    best, best_at, total, begin = 0.0, (0, 0), 0.0, 0
    for i, (_, j) in enumerate(pairs):
        gap = (j - pairs[i - 1][1] - 1) / 2 if i > begin else 0.0
        if total - gap <= 0:
            total, begin = 1.0, i
        else:
            total += 1 - gap
        if total > best:
            best, best_at = total, (begin, i + 1)
    return pairs[slice(*best_at)]


class Scanner:
    def __init__(self, templates: dict[str, str], coverage: float = COVERAGE):
        self.templates = {name: words_of(text) for name, text in sorted(templates.items())}
        self.templates = {name: own for name, own in self.templates.items() if own}
        self.coverage = {name: coverage if len(own) >= SHORT else 1.0 for name, own in self.templates.items()}
        spread = Counter(w for own in self.templates.values() for w in set(own))
        self.rare: dict[str, list[str]] = {}
        self.need: dict[str, int] = {}
        self.seeds = set()
        for name, own in self.templates.items():
            counts = Counter(own)
            lacking = int(len(own) * (1 - self.coverage[name]) + 1e-9)
            # A text that lacks at most so many of a template's words has one of its longest words.
            left = int(len(own) * (1 - coverage) + 1e-9)
            for w in sorted(counts, key=lambda w: (-len(w), w)):
                if left < 0:
                    break
                self.seeds.add(w)
                left -= counts[w]
            # The words of fewest templates, until half of them cannot be lacking.
            chosen = 0
            for w in sorted(counts, key=lambda w: (spread[w], -len(w), w)):
                if chosen > 2 * lacking:
                    break
                self.rare.setdefault(w, []).append(name)
                chosen += counts[w]
            self.need[name] = max(1, chosen - lacking)

    def scan(self, text: str) -> list[tuple]:
        """license, first and end word, matched words, template words, coverage."""
        words = words_of(text)
        places: dict[str, list[int]] = {}
        for p, w in enumerate(words):
            for name in self.rare.get(w, ()):
                places.setdefault(name, []).append(p)
        found = []
        for name, at in sorted(places.items()):
            own, least = self.templates[name], self.coverage[name]
            longest = int(len(own) / least + 1e-9)
            for lo, hi in self._regions(at, longest, self.need[name], len(words)):
                pairs = strongest(align(own, words[lo:hi]))
                if not pairs:
                    continue
                begin, end = lo + pairs[0][1], lo + pairs[-1][1] + 1
                share = len(pairs) / max(len(own), end - begin)
                if share >= least:
                    found.append((name, begin, end, len(pairs), len(own), share))
        return self._best(found)

    def _regions(self, at: list[int], longest: int, need: int, end: int):
        """A region begins before a rare word that enough others follow within the reach of a notice."""
        done, step = -1, max(1, longest // 2)
        for i, p in enumerate(at):
            if p < done or i + need > len(at) or at[i + need - 1] - p >= longest:
                continue
            done = p + step
            yield max(0, p - longest), min(end, done + longest)

    def _best(self, found: list[tuple]) -> list[tuple]:
        """The strongest of notices that overlap."""
        kept: list[tuple] = []
        begins: list[int] = []
        for f in sorted(set(found), key=lambda f: (-f[3] * f[5], f[1], f[2], f[0])):
            i = bisect_left(begins, f[2])  # kept notices do not overlap: only the last that begins before f's end can
            if i and kept[i - 1][2] > f[1]:
                continue
            kept.insert(i, f)
            begins.insert(i, f[1])
        return kept


def scan_licenses(
    documents: DataFrame,
    templates: dict[str, str] | None = None,
    key: str = "doc_id",
    text: str = "text",
    coverage: float = COVERAGE,
) -> DataFrame:
    """A row of ``FOUND`` for every notice in every text."""
    templates = templates or TEMPLATES
    rows = documents.select(F.col(f"`{key}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    scanner = Scanner(templates, coverage)

    def run(batches):
        import ahocorasick

        words = ahocorasick.Automaton()
        for w in sorted(scanner.seeds):
            words.add_word(w, w)
        words.make_automaton()
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0), batch.column(1).to_pylist()):
                if text and next(words.iter(text.lower()), None):  # most texts end here
                    out += [(doc_id.as_py(), *f) for f in scanner.scan(text)]
            kinds = [pa.int64(), pa.string(), *[pa.int64()] * 4, pa.float64()]
            columns = [pa.array(c, t) for c, t in zip(zip(*out), kinds)] if out else [pa.array([], t) for t in kinds]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in FOUND.split(", ")])

    return rows.mapInArrow(run, FOUND)
