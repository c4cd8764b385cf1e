"""License texts in documents by patience alignment."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmine.llm import texts

# License notices and texts.
LICENSES: dict[str, str] = {
    "apache-2.0-note": "Licensed under the Apache License, Version 2.0.",
    "mit-note": "Released under the MIT License.",
    "gpl-3.0-note": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-note": "Licensed under CC BY-NC 4.0.",
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "bsd-2-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list "
        "of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright "
        "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided "
        "with the distribution."
    ),
    "apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the '
        "specific language governing permissions and limitations under the License."
    ),
    "bsd-3-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list "
        "of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright "
        "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided "
        "with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used "
        "to endorse or promote products derived from this software without specific prior written permission."
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "epl-2.0": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 "
        "which is available at https://www.eclipse.org/legal/epl-2.0/"
    ),
    "epl-1.0": (
        "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse "
        "Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"
    ),
    "zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
        "liable for any damages arising from the use of this software. Permission is granted to anyone to use this software "
        "for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the "
        "following restrictions"
    ),
    "bsl-1.0": "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)",
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, "
        "use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any "
        "purpose, commercial or non-commercial, and by any means."
    ),
}

#: Versions of the notice of the GNU licenses: (what it covers, license, version).
GNU_NOTICES = {
    "gpl-2.0": ("program", "General", "2"), "gpl-3.0": ("program", "General", "3"),
    "lgpl-2.1": ("library", "Lesser General", "2.1"), "lgpl-3.0": ("library", "Lesser General", "3"),
    "agpl-3.0": ("program", "Affero General", "3"),
}
GNU_NOTICE = (
    "This {0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1} Public License as "
    "published by the Free Software Foundation, either version {2} of the License, or (at your option) any later version. "
    "This {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
    "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {1} Public License for more details."
)
#: Creative Commons licenses of version 4.0, whose notice differs by the name only.
CREATIVE_COMMONS = {
    "cc-by-4.0": "Attribution", "cc-by-sa-4.0": "Attribution-ShareAlike", "cc-by-nd-4.0": "Attribution-NoDerivatives",
    "cc-by-nc-4.0": "Attribution-NonCommercial", "cc-by-nc-sa-4.0": "Attribution-NonCommercial-ShareAlike",
    "cc-by-nc-nd-4.0": "Attribution-NonCommercial-NoDerivatives",
}
CREATIVE_COMMONS_NOTICE = "This work is licensed under a Creative Commons {0} 4.0 International License."

LICENSES.update({name: GNU_NOTICE.format(*parts) for name, parts in GNU_NOTICES.items()})
LICENSES.update({name: CREATIVE_COMMONS_NOTICE.format(full) for name, full in CREATIVE_COMMONS.items()})

#: Words are runs of ASCII letters and digits and of all other letters' bytes.
SEPARATOR = np.ones(256, bool)
SEPARATOR[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest chain of pairs, sorted by the first, in which the second grows too."""
    tails, heads, before = [], [], [-1] * len(pairs)
    for i, (_, y) in enumerate(pairs):
        k = bisect_left(tails, y)
        before[i] = heads[k - 1] if k else -1
        tails[k : k + 1] = [y]
        heads[k : k + 1] = [i]
    chain, at = [], heads[-1] if heads else -1
    while at >= 0:
        chain.append(pairs[at])
        at = before[at]
    return chain[::-1]


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Aligned (i, j) with a[i] == b[j], growing in both: equal ends first, then words unique
    to both sides as anchors along their longest chain, then each gap in the same way."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        count_a, count_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {w: j for j, w in enumerate(b[b0:b1], b0) if count_b[w] == 1}
        anchors = increasing([(i, place[w]) for i, w in enumerate(a[a0:a1], a0) if count_a[w] == 1 and w in place])
        if not anchors:
            continue
        i0, j0 = a0, b0
        for i, j in [*anchors, (a1, b1)]:
            todo.append((i0, i, j0, j))
            i0, j0 = i + 1, j + 1
        out += anchors
    return sorted(out)


@dataclass(frozen=True)
class Template:
    name: str
    words: tuple[int, ...]
    seed: int  # words of a run that a good alignment must share


class Scanner:
    """Finds templates in word sequences. A run of ``seed`` words shared with a template
    gives the place where it may lie; there text and template are aligned."""

    def __init__(self, templates: dict[str, str], percent: int):
        self.percent, self.templates, self.seeds = percent, [], {}
        for name, text in templates.items():
            words = word_hashes(text)
            if len(words):
                self.templates.append(Template(name, tuple(words.tolist()), min(len(words), 3 if len(words) >= 15 else 2)))
        for n in {t.seed for t in self.templates}:
            table: dict[int, list[tuple[int, int]]] = defaultdict(list)
            for k, t in enumerate(self.templates):
                if t.seed == n:
                    for at, h in enumerate(texts.run_hashes(np.array(t.words, np.uint64), n).tolist()):
                        table[h].append((k, at))
            self.seeds[n] = (np.array(sorted(table), np.uint64), table)

    def hits(self, words: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """Per seed length the places, and their hashes, of runs that some template has."""
        out = {}
        for n, (keys, _) in self.seeds.items():
            runs = texts.run_hashes(words, n)
            at = np.searchsorted(keys, runs)
            at[at == len(keys)] = 0
            place = np.flatnonzero(keys[at] == runs) if len(runs) else np.zeros(0, np.int64)
            out[n] = (place, runs[place])
        return out

    def scan(self, words: np.ndarray, hits: dict[int, tuple[np.ndarray, np.ndarray]]) -> list[tuple[str, float, int, int]]:
        """(template, coverage, first word, last word) of the alignments that cover at least
        ``percent`` of a template, best first and without overlap per template."""
        starts: dict[int, set[int]] = defaultdict(set)
        for n, (place, runs) in hits.items():
            for p, h in zip(place.tolist(), runs.tolist(), strict=True):
                for k, at in self.seeds[n][1][h]:
                    starts[k].add(p - at)
        found = []
        for k, begins in starts.items():
            t = self.templates[k]
            n, slack = len(t.words), max(1, len(t.words) * (100 - self.percent) // 100)
            places, last = [], None
            for s in sorted(begins):
                if last is None or s > last + slack:
                    places.append(s)
                    last = s
            good = []
            for s in places:
                lo, hi = max(0, s - slack), min(len(words), s + n + slack)
                pairs = patience(words[lo:hi].tolist(), list(t.words))
                if pairs and 100 * len(pairs) >= self.percent * n:
                    good.append((len(pairs) / n, lo + pairs[0][0], lo + pairs[-1][0]))
            taken: list[tuple[int, int]] = []
            for cover, first, last_word in sorted(good, key=lambda g: (-g[0], g[2] - g[1], g[1])):
                if all(last_word < a or first > b for a, b in taken):
                    taken.append((first, last_word))
                    found.append((t.name, cover, first, last_word))
        return best_variants(sorted(found, key=lambda f: (f[2], f[0])), {t.name: len(t.words) for t in self.templates})


def best_variants(found: list[tuple[str, float, int, int]], lengths: dict[str, int]) -> list[tuple[str, float, int, int]]:
    """Finds sorted by place, without those that lie where a find with fewer unaligned words, of
    text and template together, lies: the words both span are at least 80 percent of the longer.
    Ties stay, and so does a notice inside a longer text. Finds of one template never overlap,
    so few are open at any place."""
    beaten, open_finds = set(), []
    unaligned = [b - a + 1 + lengths[n] - 2 * round(cover * lengths[n]) for n, cover, a, b in found]
    for i, (_, _, first, last) in enumerate(found):
        open_finds = [k for k in open_finds if found[k][3] >= first]
        for k in open_finds:
            _, _, begin, end = found[k]
            shared = min(last, end) - first + 1
            if 100 * shared >= 80 * (max(last - first, end - begin) + 1) and unaligned[i] != unaligned[k]:
                beaten.add(i if unaligned[i] > unaligned[k] else k)
        open_finds.append(i)
    return [f for i, f in enumerate(found) if i not in beaten]


def word_hashes(text: str) -> np.ndarray:
    data, offsets = texts.utf8(pa.array([text]))
    starts, ends, _ = texts.word_spans(data, offsets, SEPARATOR)
    return texts.span_hashes(texts.prefix_hashes(data, texts.FOLDED_CODES), starts, ends)


FOUND = "license string, coverage double, first_word long, last_word long"


def scan_licenses(
    docs: DataFrame, templates: dict[str, str] | None = None, percent: int = 80, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(key, license, coverage, first_word, last_word): one row per place where an alignment
    covers at least ``percent`` of a template's words. Nothing is shuffled.

    Words are runs of letters and digits, A-Z folded. A template occurs where a run of two
    words (three, for templates of 15 words and more) agrees and the patience alignment of
    the text around it with the template is good enough; of templates that differ by a version
    or a few words only the one with the fewest unaligned words is named at a place. Null and empty texts and templates
    hold nothing; a null key is passed on; repeated rows give repeated finds; an empty table
    gives no rows; other columns are left out.
    """
    templates = LICENSES if templates is None else templates
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    kind = rows.schema["_key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, percent)
        for batch in texts.slices(batches, "_text"):
            data, offsets = texts.utf8(batch.column("_text"))
            starts, ends, words = texts.word_spans(data, offsets, SEPARATOR)
            hashes = texts.span_hashes(texts.prefix_hashes(data, texts.FOLDED_CODES), starts, ends)
            hits = scanner.hits(hashes)
            found, rows_of = [], []
            cuts = {n: np.searchsorted(place, words) for n, (place, _) in hits.items()}
            for i in range(len(batch)):
                own = {n: (hits[n][0][c[i] : c[i + 1]] - words[i], hits[n][1][c[i] : c[i + 1]]) for n, c in cuts.items() if c[i + 1] > c[i]}
                if own:
                    # A run that reaches into the next row is cut off by the row's own words.
                    for f in scanner.scan(hashes[words[i] : words[i + 1]], own):
                        found.append(f)
                        rows_of.append(i)
            cols = list(zip(*found, strict=True)) if found else [[], [], [], []]
            kinds = (pa.string(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("_key").take(pa.array(rows_of, pa.int64())), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))],
                names=["_key", "license", "coverage", "first_word", "last_word"],
            )

    return rows.mapInArrow(run, f"_key {kind}, {FOUND}").withColumnRenamed("_key", key)
