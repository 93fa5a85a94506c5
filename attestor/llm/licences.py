"""Licence scan by a generalised suffix automaton of licence words.

All templates and base phrases go into one automaton over words.  A document is
streamed through it, which gives the matching statistics: at each word the
longest run ending there that occurs in some template.  Runs of ``MIN_RUN``
words or more that cannot be extended are chained, in order, along each
template; a template whose words are covered to ``MIN_COVER`` gives its label
and span.  Base phrases are reported at every place where they end.

Words that no template has, and word pairs that stand in no template, reset the
automaton, so only stretches of known pairs are streamed; that skips nothing.

Defined results: null and empty texts have no words, no labels and score 0; a
text of any length is streamed whole; equal rows give equal rows; an empty
table gives none; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from attestor.llm.common import distinct_words, documents, lean, ship, slices

#: Base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notices by which well-known licences are stated, by label.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "mit": [
        "Released under the MIT License",
        "Licensed under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
    ],
    "gpl-3.0": [
        "licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0",
    ],
    "gpl-2.0": [
        "licensed under the GNU General Public License, version 2",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-2.0",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Licensed under the BSD License",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES",
        "SPDX-License-Identifier: BSD-2-Clause",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "cc-by-nc-4.0": [
        "Licensed under CC BY-NC 4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ],
    "cc-by-sa-4.0": [
        "Licensed under CC BY-SA 4.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ],
    "cc-by-4.0": [
        "Licensed under CC BY 4.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
        "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", "SPDX-License-Identifier: MPL-2.0"],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "SPDX-License-Identifier: ISC"],
    "unlicense": ["This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense"],
    # short, so that the notices of the GPL do not cover them
    "lgpl": ["GNU Lesser General Public License", "SPDX-License-Identifier: LGPL-2.1", "SPDX-License-Identifier: LGPL-3.0"],
    "agpl": ["GNU Affero General Public License", "SPDX-License-Identifier: AGPL-3.0"],
    "cc0-1.0": [
        "Licensed under CC0 1.0",
        "This work is dedicated to the public domain under the Creative Commons CC0 1.0 Universal Public Domain Dedication",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
        "SPDX-License-Identifier: CC0-1.0",
    ],
    "epl-2.0": ["Eclipse Public License 2.0", "SPDX-License-Identifier: EPL-2.0"],
    "cc-by-nd-4.0": ["Licensed under CC BY-ND 4.0", "Commons Attribution-NoDerivatives 4.0", "SPDX-License-Identifier: CC-BY-ND-4.0"],
    "zlib": [
        "Licensed under the zlib License",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely",
        "SPDX-License-Identifier: Zlib",
    ],
}
#: Shortest run that counts, share of a template to cover, and words that may lie between chained runs.
MIN_RUN, MIN_COVER, MAX_GAP = 3, 0.85, 8
#: Lower-case A-Z; ASCII characters that are no word characters become spaces.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str) -> list[str]:
    return text.encode().translate(TABLE).decode().split(" ")


class Automaton:
    """Suffix automaton of several word sequences, numbered words."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.long = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]
        for k, seq in enumerate(sequences):
            at = 0
            for i, w in enumerate(seq):
                at = self._extend(at, w)
                self.ends[at].add((k, i + 1))
        # a state's ends are also those of the states that its link leads to
        for s in sorted(range(1, len(self.long)), key=lambda s: -self.long[s]):
            if self.link[s] > 0:
                self.ends[self.link[s]] |= self.ends[s]

    def _state(self, long: int, of: int | None = None) -> int:
        self.next.append(dict(self.next[of]) if of is not None else {})
        self.link.append(self.link[of] if of is not None else -1)
        self.long.append(long)
        self.ends.append(set())
        return len(self.long) - 1

    def _split(self, p: int, q: int, w: int) -> int:
        """Part of q that is reached by p's string and w."""
        if self.long[q] == self.long[p] + 1:
            return q
        c = self._state(self.long[p] + 1, q)
        self.link[q] = c
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = c
            p = self.link[p]
        return c

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:
            return self._split(last, self.next[last][w], w)
        new, p = self._state(self.long[last] + 1), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        self.link[new] = 0 if p < 0 else self._split(p, self.next[p][w], w)
        return new

    def statistics(self, seq: list[int]):
        """(state, length) of the longest known run ending at each word."""
        s = long = 0
        for w in seq:
            while s and w not in self.next[s]:
                s = self.link[s]
                long = self.long[s]
            if w in self.next[s]:
                s, long = self.next[s][w], long + 1
            yield s, long


class Scanner:
    def __init__(self):
        self.names, seqs = [], []
        self.vocabulary: dict[str, int] = {}
        for label, texts in [*TEMPLATES.items(), *((label, [phrase]) for phrase, label in BASE.items())]:
            for t in texts:
                self.names.append(label)
                seqs.append([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(t) if w])
        self.sizes = list(map(len, seqs))
        self.phrases = range(len(seqs) - len(BASE), len(seqs))
        self.automaton = Automaton(seqs)
        found: dict[int, list[int]] = {}  # state: base phrases that it holds
        for k in self.phrases:
            at = 0
            for w in seqs[k]:
                at = self.automaton.next[at][w]
            found.setdefault(at, []).append(k)
        #: Base phrases that may end at a state: its own and those of shorter suffixes.
        self.reports: list[list[int]] = [[] for _ in self.automaton.long]
        for at in sorted(range(1, len(self.reports)), key=self.automaton.long.__getitem__):
            self.reports[at] = self.reports[self.automaton.link[at]] + found.get(at, [])
        n = len(self.vocabulary)
        self.pairs = np.zeros((n + 1, n + 1), bool)
        for s in seqs:
            self.pairs[s[:-1], s[1:]] = True
        self.starts = np.zeros((n + 1, n + 1), bool)  # pairs that are a whole base phrase
        for k in self.phrases:
            if self.sizes[k] == 2:
                self.starts[seqs[k][0], seqs[k][1]] = True

    def document(self, runs: list[tuple[int, list[int]]]) -> tuple[list[tuple[int, str]], list[tuple[str, int, int, float]]]:
        """Base places (start, label) and spans (label, start, stop, share covered) from stretches of known words."""
        places, matches = [], []
        for start, seq in runs:
            stats = list(self.automaton.statistics(seq))
            for i, (s, long) in enumerate(stats):
                here = self.automaton.ends[s]
                places += [(start + i + 1 - self.sizes[k], self.names[k]) for k in self.reports[s] if long >= self.sizes[k]]
                if long >= MIN_RUN and not (i + 1 < len(stats) and stats[i + 1][1] == long + 1):
                    matches.append((start + i + 1 - long, start + i + 1, here))
        return places, self.chain(matches)

    def chain(self, matches) -> list[tuple[str, int, int, float]]:
        open_: dict[int, tuple[int, int, int, int]] = {}  # template: first word, last word, place in template, words covered
        spans = []
        for a, b, ends in matches:
            best: dict[int, tuple[int, int, int, int]] = {}
            for k, stop in sorted(ends):
                here = (a, b, stop, b - a)
                if k in open_:
                    first, last, at, covered = open_[k]
                    new = min(b - max(a, last), stop - at)
                    if a - last <= MAX_GAP and new > 0:
                        here = max(here, (first, b, stop, covered + new), key=lambda x: x[3])
                if k not in best or here[3] > best[k][3]:
                    best[k] = here
            for k, here in best.items():
                open_[k] = here
                if here[3] >= MIN_COVER * self.sizes[k]:
                    spans.append((self.names[k], here[0], here[1], here[3] / self.sizes[k]))
        final = {}
        for label, a, b, cover in spans:  # a chain that grows is reported once, with its best cover
            if cover >= final.get((label, a), (0, 0))[1]:
                final[label, a] = (b, cover)
        return sorted((label, a, b, cover) for (label, a), (b, cover) in final.items())

    def batch(self, doc_ids, text: pa.Array) -> list[tuple]:
        raw = text.cast(pa.binary()).fill_null(b"")
        raw = pa.concat_arrays([raw])
        kept = pa.array(raw.to_pylist() if raw.offset else raw, pa.binary()) if raw.offset else raw
        offsets, data = kept.buffers()[1], kept.buffers()[2]
        folded = pa.Array.from_buffers(pa.string(), len(kept), [None, offsets, pa.py_buffer((data.to_pybytes() if data else b"").translate(TABLE))])
        known, number, n_words = distinct_words(folded)
        none = len(self.vocabulary)
        of = np.fromiter((self.vocabulary.get(w, none) for w in (x.decode() for x in known)), np.int32, len(known))
        ids = of[number] if len(number) else np.zeros(0, np.int32)
        ends = np.cumsum(n_words)
        doc = np.repeat(np.arange(len(n_words)), n_words)
        good = self.pairs[ids[:-1], ids[1:]] & (doc[:-1] == doc[1:]) if len(ids) > 1 else np.zeros(0, bool)
        edge = np.diff(np.concatenate(([0], good.astype(np.int8), [0])))
        a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + 1  # words a to b - 1 make a stretch
        long = b - a >= MIN_RUN
        long |= self.starts[ids[a], ids[np.minimum(a + 1, len(ids) - 1)]] if len(a) else long
        runs: dict[int, list[tuple[int, list[int]]]] = {}
        for x, y in zip(a[long].tolist(), b[long].tolist()):
            runs.setdefault(int(doc[x]), []).append((x - int(ends[doc[x]] - n_words[doc[x]]), ids[x:y].tolist()))
        out = []
        for k, doc_id in enumerate(doc_ids):
            places, spans = self.document(runs[k]) if k in runs else ([], [])
            at = [x for x, _ in places]
            base = sorted({x for _, x in places})
            labels = sorted({*base, *(x for x, _, _, _ in spans)})
            out.append((doc_id, int(n_words[k]), len(at), min(at, default=None), max(at, default=None), ",".join(base), ",".join(labels), min(1.0, max((c for *_, c in spans), default=0.0)), [dict(zip(("label", "start", "stop", "cover"), s)) for s in spans]))
        return out


NAMES = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,start:long,stop:long,cover:double>>"
SPANS = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("cover", pa.float64())]))
KINDS = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64(), SPANS]


def scan(docs: DataFrame) -> DataFrame:
    """Base places, labels, best cover and covered template spans of each document."""
    ship(docs.sparkSession)

    def run(batches):
        scanner = Scanner()
        for whole in batches:
            for part in slices(whole, 12 << 20):
                rows = scanner.batch(part.column(0).to_pylist(), part.column(1))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), KINDS)], NAMES)

    return docs.select("doc_id", "text").mapInArrow(lean(run), SCHEMA)


def op10_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir)).select(*NAMES[:-1])
