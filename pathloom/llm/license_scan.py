"""Licence scan by a generalised suffix automaton over the words of licence texts.

The automaton is built once per worker from all templates (small, fixed).  Each text streams through it: after every
word, the matching statistic is the length of the longest run of words ending there that occurs in some template.
Runs that cannot be extended and are long enough become anchors; per template, anchors that rise in text and template
alike, with small gaps, are chained, and the best chain gives a covered span of the template.

Defined results: a null text counts as empty; without words all counts are 0, first_word and last_word null, labels
empty and score 0; very long texts are streamed whole; repeated rows are scanned each; of equally good spans the first in
the text counts; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

# Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Published licence wordings, by label.
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("gpl", "licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by", "Licensed under CC BY-NC 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by", "This work is licensed under the Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("bsd", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."),
    ("lgpl", "licensed under the GNU Lesser General Public License"),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details."),
    ("agpl", "licensed under the GNU Affero General Public License"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("boost", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so"),
]

# Identifiers of the SPDX licence list, by label.
SPDX = {
    "mit": "MIT MIT-0",
    "apache": "Apache-2.0 Apache-1.1",
    "gpl": "GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later",
    "lgpl": "LGPL-2.0-only LGPL-2.0-or-later LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later",
    "agpl": "AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later",
    "mpl": "MPL-1.1 MPL-2.0",
    "epl": "EPL-1.0 EPL-2.0",
    "bsd": "BSD-2-Clause BSD-3-Clause BSD-4-Clause 0BSD",
    "isc": "ISC",
    "zlib": "Zlib",
    "boost": "BSL-1.0",
    "unlicense": "Unlicense",
    "cc0": "CC0-1.0",
    "cc-by": "CC-BY-3.0 CC-BY-4.0",
    "cc-by-sa": "CC-BY-SA-3.0 CC-BY-SA-4.0",
    "cc-by-nc": "CC-BY-NC-3.0 CC-BY-NC-4.0",
}
TEMPLATES += [(label, f"SPDX-License-Identifier: {name}") for label, names in SPDX.items() for name in names.split()]

#: Words in an anchor at least; words skipped inside a chain at most; share of a template that makes a label, all of it where
#: the template has fewer than SHORT words.
MIN_ANCHOR, MAX_GAP, MIN_COVER, SHORT = 3, 12, 0.6, 12

#: Bytes 0-9, a-z and those over 0x7F are parts of words; all others part them.
_WORDS = bytes(i if 0x30 <= i <= 0x39 or 0x61 <= i <= 0x7A or i > 0x7F else 0x20 for i in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode().lower().translate(_WORDS).split()


class LicenceAutomaton:
    """Suffix automaton of several word sequences; every state knows where in the templates it ends."""

    def __init__(self, templates: list[tuple[str, str]]):
        self.labels = [label for label, _ in templates]
        sequences = [words_of(text) for _, text in templates]
        self.sizes = [len(s) for s in sequences]
        self.vocabulary = {w for s in sequences for w in s}
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[list[tuple[int, int]]] = [[]]
        for t, sequence in enumerate(sequences):
            last = 0
            for p, word in enumerate(sequence):
                last = self._extend(last, word, ends)
                ends[last].append((t, p))
        self.ends: list[list[tuple[int, int]]] = [list(x) for x in ends]
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            self.ends[self.link[state]].extend(self.ends[state])
        self.ends[0] = []

    def _new(self, length: int, ends: list) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        ends.append([])
        return len(self.link) - 1

    def _split(self, state: int, target: int, word: bytes, ends: list) -> int:
        """The target itself if it is one word longer than state, else a copy of it that is."""
        if self.length[target] == self.length[state] + 1:
            return target
        copy = self._new(self.length[state] + 1, ends)
        self.next[copy], self.link[copy], self.link[target] = dict(self.next[target]), self.link[target], copy
        while state >= 0 and self.next[state].get(word) == target:
            self.next[state][word] = copy
            state = self.link[state]
        return copy

    def _extend(self, last: int, word: bytes, ends: list) -> int:
        if word in self.next[last]:
            return self._split(last, self.next[last][word], word, ends)
        new, state = self._new(self.length[last] + 1, ends), last
        while state >= 0 and word not in self.next[state]:
            self.next[state][word] = new
            state = self.link[state]
        self.link[new] = 0 if state < 0 else self._split(state, self.next[state][word], word, ends)
        return new

    def statistics(self, words: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """(position, state, length) after each word that is in the vocabulary; after any other word, the length is 0."""
        state, size, before, vocabulary, follow, link, length = 0, 0, -2, self.vocabulary, self.next, self.link, self.length
        for i in [i for i, w in enumerate(words) if w in vocabulary]:
            if i != before + 1:
                state, size = 0, 0
            before, word = i, words[i]
            while word not in follow[state]:
                state = link[state]
                size = length[state]
            state, size = follow[state][word], size + 1
            yield i, state, size

    def anchors(self, words: list[bytes]) -> list[tuple[int, int, int]]:
        """(first word, words, state) of the runs of at least MIN_ANCHOR words that the next word does not extend."""
        out, held = [], None
        for i, state, size in self.statistics(words):
            if held and (i != held[0] + 1 or size <= held[2]):
                out.append((held[0] - held[2] + 1, held[2], held[1]))
            held = (i, state, size) if size >= MIN_ANCHOR else None
        if held:
            out.append((held[0] - held[2] + 1, held[2], held[1]))
        return out

    def spans(self, words: list[bytes]) -> list[tuple[str, int, int, int, float]]:
        """(label, template, first word, end word, covered share) of the best chain of each template, in groups of near anchors."""
        groups: dict[int, list[list[tuple[int, int, int]]]] = {}
        for start, size, state in self.anchors(words):
            for t, end in self.ends[state]:
                mine = groups.setdefault(t, [[]])
                if mine[-1] and start - (mine[-1][-1][0] + mine[-1][-1][2]) > MAX_GAP:
                    mine.append([])
                mine[-1].append((start, end - size + 1, size))
        out = []
        for t, clusters in sorted(groups.items()):
            for cluster in filter(None, clusters):
                best: tuple[int, int, int] = (0, 0, 0)  # covered words, first, end
                top: list[tuple[int, int, int]] = [(0, 0, 0)] * (self.sizes[t] + 1)  # by template position: best chain that ends before it
                for start, at, size in cluster:
                    covered, first, end = max(top[: at + 1], key=lambda x: x[0])
                    skip = max(0, end - start) if covered else 0
                    chain = (covered + size - skip, first if covered else start, start + size)
                    place = at + size
                    if chain[0] > top[place][0]:
                        top[place] = chain
                    if chain[0] > best[0]:
                        best = chain
                out.append((self.labels[t], t, best[1], best[2], best[0] / self.sizes[t]))
        return out


def told_apart(spans: list[tuple[str, int, int, int, float]], sizes: list[int]) -> list[tuple[str, int, int, int, float]]:
    """Spans that cover enough of their template, in the order of the text.

    Licences share wordings: where two spans overlap by half of the shorter one, the one that covers more of its template
    counts, of equal shares that of the longer template.
    """
    enough = [s for s in spans if s[4] >= (MIN_COVER if sizes[s[1]] >= SHORT else 1)]
    out: list[tuple[str, int, int, int, float]] = []
    for s in sorted(enough, key=lambda s: (-s[4], -sizes[s[1]], s[2], s[1])):
        if all(2 * (min(s[3], o[3]) - max(s[2], o[2])) < min(s[3] - s[2], o[3] - o[2]) for o in out):
            out.append(s)
    return sorted(out, key=lambda s: (s[2], s[1]))


@lru_cache(maxsize=1)
def automaton() -> LicenceAutomaton:
    return LicenceAutomaton(TEMPLATES)


_BASE = sorted((tuple(p.encode().split()), label) for p, label in PHRASES.items())
_FIRST = {p[0]: (p, label) for p, label in _BASE}


def base_places(words: list[bytes]) -> list[tuple[int, str]]:
    """Where a phrase's words stand one after another."""
    out = []
    for i in [i for i, w in enumerate(words) if w in _FIRST]:
        phrase, label = _FIRST[words[i]]
        if tuple(words[i : i + len(phrase)]) == phrase:
            out.append((i, label))
    return out


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,template:int,first_word:long,end_word:long,covered:double>>"
_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())]
    + [("spans", pa.list_(pa.struct([("label", pa.string()), ("template", pa.int32()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("covered", pa.float64())])))]
)


def scan_text(text: str | None) -> dict:
    words = words_of(text or "")
    base, spans = base_places(words), told_apart(automaton().spans(words), automaton().sizes)
    mine = {label for _, label in base}
    return {
        "n_words": len(words),
        "n_base": len(base),
        "first_word": base[0][0] if base else None,
        "last_word": base[-1][0] if base else None,
        "base_labels": ",".join(sorted(mine)),
        "labels": ",".join(sorted(mine | {s[0] for s in spans})),
        "score": min(1.0, max([s[4] for s in spans], default=0.5 if base else 0.0)),
        "spans": [dict(zip(("label", "template", "first_word", "end_word", "covered"), s, strict=True)) for s in spans],
    }


def scan_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: counts of base phrases, labels, the best covered share (0.5 at least where a phrase stands), spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [scan_text(t.as_py()) for t in batch.column(1)]
            for i, row in zip(batch.column(0).to_pylist(), rows, strict=True):
                row["doc_id"] = i
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return docs.selectExpr(f"cast({id_col} as long) doc_id", f"{text_col} as text").mapInArrow(run, SCHEMA)
