"""Licence scan: a generalised suffix automaton of licence texts, matching statistics, and chains of long matches.

The automaton holds every substring of the word sequences of all templates. A text is streamed through it once: after
each word it gives the longest suffix of what was read that occurs in any template. A phrase ends wherever its state is
that suffix's state or an ancestor of it. Maximal long matches are chained in text order per template: matches of one
template whose gaps in text and template are small and alike are joined to a span, and a span that covers enough of its
template gives the template's label. A notice with a name between its first and last words is found by those two. Words
that several spans claim go to the one that covers most, and a span of another label that has lost more than half of its
words to such spans is dropped, so a licence is not taken for its near relative.

Words are runs of ASCII digits, ASCII letters in lower case, and all characters beyond ASCII. Null and empty texts have
no words, no labels and score 0. Texts of any length are streamed whole, in time in proportion to their length. The
input's columns are kept, those named like an added one are replaced; repeated rows are scanned each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .licence_texts import BODIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})

#: Phrases of the base scan and their labels (fixed values).
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Label and text of parts of licences, notices and one-line statements (fixed values: public licence texts).
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit", "Released under the MIT License."),
    ("mit", "This project is licensed under the terms of the MIT license."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see http://www.gnu.org/licenses/"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"),
    ("boost", "Distributed under the Boost Software License, Version 1.0."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by", "This work is licensed under the Creative Commons Attribution 4.0 International License."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. Released under CC0 1.0 Universal."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("gpl", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    ("lgpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    *BODIES,
)

#: Label and first and last words of notices that have a name between them (fixed values).
NOTICES = (("proprietary", "Copyright", "All rights reserved"),)

#: Names of licences by which a text states them, by label (fixed values).
TITLES = {
    "agpl": ("GNU Affero General Public License",), "boost": ("Boost Software License",), "bsd": ("BSD License", "BSD 2-Clause License", "BSD 3-Clause License"), "cc-by": ("Creative Commons Attribution License",),
    "cc-by-nc": ("Creative Commons Attribution-NonCommercial",), "cc-by-sa": ("Creative Commons Attribution-ShareAlike",), "cc0": ("CC0 1.0 Universal", "Creative Commons Zero"), "epl": ("Eclipse Public License",),
    "eupl": ("European Union Public Licence",), "isc": ("ISC License",), "lgpl": ("GNU Lesser General Public License", "GNU Library General Public License"), "mpl": ("Mozilla Public License",), "zlib": ("zlib License",),
}

#: Identifiers of the SPDX list that stand in file headers, by label; "-only" and "-or-later" may follow (fixed values).
SPDX = {
    "agpl": ("AGPL-3.0",), "apache": ("Apache-2.0",), "boost": ("BSL-1.0",), "bsd": ("BSD-2-Clause", "BSD-3-Clause"), "cc-by": ("CC-BY-4.0",), "cc-by-nc": ("CC-BY-NC-4.0",), "cc-by-sa": ("CC-BY-SA-4.0",), "cc0": ("CC0-1.0",), "epl": ("EPL-2.0",),
    "eupl": ("EUPL-1.2",), "gpl": ("GPL-2.0", "GPL-3.0"), "isc": ("ISC",), "lgpl": ("LGPL-2.1", "LGPL-3.0"), "mit": ("MIT",), "mpl": ("MPL-2.0",), "unlicense": ("Unlicense",), "zlib": ("Zlib",),
}
TEMPLATES += tuple((label, title) for label, titles in TITLES.items() for title in titles)
TEMPLATES += tuple((label, f"SPDX-License-Identifier: {name}") for label, names in SPDX.items() for name in names)

#: Words of a match that may join a chain, words that a gap inside a chain may have, and the share of a template that
#: its chain must cover for the label.
MIN_MATCH, MAX_GAP, MIN_COVER = 4, 6, 0.8


def words_of(text: str) -> list[str]:
    return WORD.findall(text.translate(LOWER) if not text.islower() else text)


class Automaton:
    """Generalised suffix automaton over word numbers. ``ends``: where in which templates each state's words end."""

    def __init__(self, templates=TEMPLATES, phrases=PHRASES, notices=NOTICES):
        ends_of = [(label, words_of(first), words_of(last)) for label, first, last in notices]
        #: the templates, and after them the notices, their two ends put together
        self.templates = [*((label, words_of(text)) for label, text in templates), *((label, first + last) for label, first, last in ends_of)]
        self.notices = [words for _, first, last in ends_of for words in (first, last)]
        self.phrases = [(label, words_of(text)) for text, label in phrases.items()]
        self.number: dict[str, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[set[tuple[int, int]]] = [set()]
        self.ends = ends
        for t, words in enumerate([*(words for _, words in [*self.templates, *self.phrases]), *self.notices]):
            last = 0
            for at, word in enumerate(words):
                last = self.extend(last, self.number.setdefault(word, len(self.number)))
                if t < len(self.templates):
                    ends[last].add((t, at))
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            if self.link[state] > 0:
                ends[self.link[state]] |= ends[state]
        #: the phrases, and after them the whole templates and the ends of notices, that end in a state: (number, words), by following its links
        own: dict[int, list[tuple[int, int]]] = {}
        for p, words in enumerate([*(words for _, words in [*self.phrases, *self.templates]), *self.notices]):
            state = 0
            for word in words:
                state = self.next[state][self.number[word]]
            own.setdefault(state, []).append((p, len(words)))
        self.found: list[list[tuple[int, int]]] = [[] for _ in self.next]
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            self.found[state] = own.get(state, []) + self.found[max(self.link[state], 0)]

    def state(self, length: int, link: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        self.ends.append(set())
        return len(self.next) - 1

    def split(self, parent: int, word: int) -> int:
        """The state after ``word`` from ``parent`` whose longest words are one longer than the parent's."""
        child = self.next[parent][word]
        if self.length[child] == self.length[parent] + 1:
            return child
        copy = self.state(self.length[parent] + 1, self.link[child], dict(self.next[child]))
        self.link[child] = copy
        while parent >= 0 and self.next[parent].get(word) == child:
            self.next[parent][word] = copy
            parent = self.link[parent]
        return copy

    def extend(self, last: int, word: int) -> int:
        if word in self.next[last]:
            return self.split(last, word)
        new = self.state(self.length[last] + 1, 0, {})
        at = last
        while at >= 0 and word not in self.next[at]:
            self.next[at][word] = new
            at = self.link[at]
        if at >= 0:
            self.link[new] = self.split(at, word)
        return new

    def scan(self, words: list[str]) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]], list[tuple[int, int, int, int]]]:
        """(phrase, start) of every phrase, (end, words, state) of every maximal match of MIN_MATCH words or more, and the
        spans of whole templates and notices, which may end inside a longer match. A notice begins at the nearest of its first
        words that at most MAX_GAP words part from its last ones."""
        number, following, link, length, found = self.number.get, self.next, self.link, self.length, self.found
        phrases, matches, whole = [], [], []
        n_phrases, n_texts = len(self.phrases), len(self.phrases) + len(self.templates)
        first_notice = len(self.templates) - len(self.notices) // 2
        opened: dict[int, tuple[int, int]] = {}
        state = size = 0
        for at, word in enumerate(words):
            w = number(word)
            if w is None:
                if size >= MIN_MATCH:
                    matches.append((at, size, state))
                state = size = 0
                continue
            if w not in following[state]:
                if size >= MIN_MATCH:
                    matches.append((at, size, state))
                while state and w not in following[state]:
                    state = link[state]
                    size = length[state]
                if w not in following[state]:
                    continue
            state = following[state][w]
            size += 1
            for p, n in found[state]:
                if n > size:
                    continue
                if p < n_phrases:
                    phrases.append((p, at - n + 1))
                elif p < n_texts:
                    whole.append((p - n_phrases, at - n + 1, at + 1, n))
                elif (p - n_texts) % 2 == 0:
                    opened[(p - n_texts) // 2] = (at - n + 1, at + 1)
                elif (k := (p - n_texts) // 2) in opened and 0 <= at - n + 1 - opened[k][1] <= MAX_GAP:
                    begin, end = opened[k]
                    whole.append((first_notice + k, begin, at + 1, end - begin + n))
        if size >= MIN_MATCH:
            matches.append((len(words), size, state))
        return phrases, matches, whole

    def spans(self, matches: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
        """(template, first word, end word, covered words) of the chains that cover enough of their template."""
        open_chains: dict[int, list[list[int]]] = {}
        done: list[tuple[int, int, int, int]] = []

        def close(t: int, chain: list[int]) -> None:
            if chain[3] >= MIN_COVER * len(self.templates[t][1]):
                done.append((t, chain[0], chain[1], chain[3]))

        for end, size, state in matches:
            for t, last in sorted(self.ends[state]):
                chains = open_chains.setdefault(t, [])
                for chain in [c for c in chains if end - size - c[1] > MAX_GAP]:
                    chains.remove(chain)
                    close(t, chain)
                begin = last + 1 - size
                fits = [c for c in chains if c[2] - MAX_GAP <= begin <= c[2] + MAX_GAP and last + 1 > c[2] and end > c[1]]
                if fits:
                    chain = max(fits, key=lambda c: c[3])
                    fresh = min(size, last + 1 - chain[2], end - chain[1])
                    chain[1], chain[2], chain[3] = end, last + 1, chain[3] + fresh
                else:
                    chains.append([end - size, end, last + 1, size])
        for t, chains in open_chains.items():
            for chain in chains:
                close(t, chain)
        return done


    def parted(self, spans: list[tuple[int, int, int, int]], n_words: int) -> list[tuple[int, int, int, int]]:
        """The spans in text order without those that lost more than half of their words to spans of other labels that cover more."""
        labels = sorted({self.templates[s[0]][0] for s in spans})
        if len(labels) < 2:
            return sorted(spans, key=lambda s: s[1:3] + s[:1])
        number = {label: k for k, label in enumerate(labels, 1)}
        owner, kept = np.zeros(n_words, np.int16), []
        for span in sorted(spans, key=lambda s: (-s[3], s[2] - s[1], *s[1:3], s[0])):
            own, part = number[self.templates[span[0]][0]], owner[span[1] : span[2]]
            if 2 * np.count_nonzero((part != 0) & (part != own)) <= len(part):
                part[part == 0] = own
                kept.append(span)
        return sorted(kept, key=lambda s: s[1:3] + s[:1])


_automaton: list[Automaton] = []

FIELDS = "n_words bigint, phrase_labels array<string>, phrase_starts array<bigint>, span_labels array<string>, span_starts array<bigint>, span_ends array<bigint>, coverage double"


def scan(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` and what the scan found.

    n_words; phrase_labels and phrase_starts, one entry for each place of a base phrase, in text order; span_labels,
    span_starts and span_ends (exclusive) of the template chains, in words; coverage, the share of the best covered
    template, 0 to 1.
    """
    names = [f.split()[0] for f in FIELDS.split(", ")]
    keep = [f for f in df.schema.fields if f.name.lower() not in names]
    source = df.select(*[F.col(f"`{f.name}`") for f in keep], F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("__text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), FIELDS])
    kinds = [pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not _automaton:
            _automaton.append(Automaton())
        automaton = _automaton[0]
        for batch in slices(batches):
            rows = []
            for value in batch.column(batch.num_columns - 1):
                words = words_of(value.as_py())
                phrases, matches, whole = automaton.scan(words)
                spans = automaton.parted(list({*automaton.spans(matches), *whole}), len(words)) if matches or whole else []
                phrases.sort(key=lambda p: (p[1], p[0]))
                best = max((min(1.0, s[3] / len(automaton.templates[s[0]][1])) for s in spans), default=0.0)
                rows.append((len(words), [automaton.phrases[p][0] for p, _ in phrases], [at for _, at in phrases], [automaton.templates[s[0]][0] for s in spans], [s[1] for s in spans], [s[2] for s in spans], best))
            columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))], [*(f.name for f in keep), *names])

    return source.mapInArrow(run, schema)
