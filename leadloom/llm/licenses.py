"""License scans: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies matches.

Texts and templates are sequences of lower-cased words and of their five-word shingles. Windows of 1, 4 or 16 shingles are signed with
BANDS x ROWS minima of permuted shingle hashes; a template signs all windows of the largest size that it holds with room to spare, a text
signs a window at each stride. Strides are such that any whole occurrence of a template holds a window of the text that is equal to a
window of the template, so it collides for certain; two windows of Jaccard similarity s collide with probability 1 - (1 - s^ROWS)^BANDS
(0.98 at 0.8), and an edited occurrence of a long template has many windows. Each retrieved place is verified on the words themselves: the
share of the template's shingles that stand in the surrounding stretch of the text must be MIN_CONTAINED or more. A template of fewer than
five words is one shingle of its own width, whose one window of one band is equal or not.

Matches of a text do not overlap: of overlapping ones that with the greatest containment, then the longest stays, so that a notice of
version 3 is not one of version 2 as well.

All texts of a slice are signed together with numpy; templates are a fixed short list, so nothing is shuffled.

Cases: null text and texts shorter than any template match nothing; repeated rows are scanned row by row; an empty table gives an empty table.
"""

from __future__ import annotations

import bisect
import functools
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_texts, sql_type

SHINGLE, MIN_CONTAINED, BANDS, ROWS = 5, 0.8, 4, 2
#: Window sizes in shingles, the stride of a text's windows, and the shingles from which a template takes the size.
SIZES = [(1, 1, 1), (4, 1, 4), (16, 8, 31)]
WORD = re.compile(r"[^\W_]+")

#: Notices and texts of licenses.
TEMPLATES = {
    "MIT notice": ("MIT", "Released under the MIT License."),
    "MIT notice, licensed": ("MIT", "Licensed under the MIT License."),
    "Apache-2.0 notice": ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    "GPL-3.0 notice": ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    "GPL-2.0 notice": ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    "CC-BY-NC-4.0 notice": ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    "CC-BY-SA-4.0 notice": ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    "CC-BY-4.0 notice": ("CC-BY-4.0", "licensed under a Creative Commons Attribution 4.0 International License"),
    "Apache-2.0 name": ("Apache-2.0", "Apache License 2.0"),
    "BSD notice": ("BSD", "Released under the BSD License"),
    "BSD notice, licensed": ("BSD", "Licensed under the BSD License"),
    "LGPL-2.1 notice": ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1"),
    "LGPL-3.0 notice": ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3"),
    "AGPL-3.0 notice": ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3"),
    "CC-BY-4.0 notice, short": ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    "CC-BY-ND-4.0 notice": ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0"),
    "CC-BY-NC-SA-4.0 notice": ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0"),
    "CC-BY-NC-ND-4.0 notice": ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0"),
    "CC-BY-SA-4.0 notice, long": ("CC-BY-SA-4.0", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0 notice, long": ("CC-BY-NC-4.0", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC0-1.0 notice": ("CC0-1.0", "has waived all copyright and related or neighboring rights to"),
    "CC0-1.0 deed": ("CC0-1.0", "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law"),
    "BSL-1.0 notice": ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0"),
    "EPL-2.0 header": ("EPL-2.0", "made available under the terms of the Eclipse Public License 2.0"),
    "EPL-1.0 header": ("EPL-1.0", "made available under the terms of the Eclipse Public License v1.0"),
    "SPDX MIT": ("MIT", "SPDX-License-Identifier: MIT"),
    "SPDX ISC": ("ISC", "SPDX-License-Identifier: ISC"),
    "SPDX Unlicense": ("Unlicense", "SPDX-License-Identifier: Unlicense"),
    "SPDX Zlib": ("Zlib", "SPDX-License-Identifier: Zlib"),
    "SPDX Apache-2.0": ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    "SPDX BSD-2-Clause": ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    "SPDX BSD-3-Clause": ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    "SPDX BSL-1.0": ("BSL-1.0", "SPDX-License-Identifier: BSL-1.0"),
    "SPDX MPL-2.0": ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    "SPDX EPL-2.0": ("EPL-2.0", "SPDX-License-Identifier: EPL-2.0"),
    "SPDX GPL-2.0": ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0"),
    "SPDX GPL-3.0": ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    "SPDX LGPL-2.1": ("LGPL-2.1", "SPDX-License-Identifier: LGPL-2.1"),
    "SPDX LGPL-3.0": ("LGPL-3.0", "SPDX-License-Identifier: LGPL-3.0"),
    "SPDX AGPL-3.0": ("AGPL-3.0", "SPDX-License-Identifier: AGPL-3.0"),
    "SPDX CC0-1.0": ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
    "SPDX CC-BY-4.0": ("CC-BY-4.0", "SPDX-License-Identifier: CC-BY-4.0"),
    "SPDX CC-BY-SA-4.0": ("CC-BY-SA-4.0", "SPDX-License-Identifier: CC-BY-SA-4.0"),
    "MPL-2.0 header": ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    "Apache-2.0 header": ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    "GPL header": ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    "MIT text": ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    "ISC text": ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "BSD text": ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    "BSD-3-Clause text": ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    "LGPL header": ("LGPL", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    "AGPL header": ("AGPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    "Unlicense text": ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    "Zlib text": ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"),
    "BSL-1.0 text": ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software"),
    "Apache-2.0 text": ("Apache-2.0", "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. \"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document. \"Licensor\" shall mean the copyright owner or entity authorized by the copyright owner that is granting the License."),
    "GPL-2.0 text": ("GPL-2.0", "The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users."),
    "GPL-3.0 text": ("GPL-3.0", "The GNU General Public License is a free, copyleft license for software and other kinds of works. The licenses for most software and other practical works are designed to take away your freedom to share and change the works."),
    "AGPL-3.0 text": ("AGPL-3.0", "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software."),
    "MPL-2.0 text": ("MPL-2.0", "\"Contributor\" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software."),
}


def words_of(text: str) -> list[str]:
    low = text.lower()  # where its length changes (U+0130), words are taken before lower-casing, as their spans are
    return WORD.findall(low) if len(low) == len(text) else [w.lower() for w in WORD.findall(text)]


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter((zlib.crc32(w.encode()) for w in words), np.uint64, len(words))


def mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """A permutation of 64-bit integers for each salt."""
    x = (x ^ np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def shingle_hashes(words: np.ndarray, width: int = SHINGLE) -> np.ndarray:
    n = max(0, len(words) - width + 1)
    out = np.zeros(n, np.uint64)
    for i in range(width):
        out = out * np.uint64(0x100000001B3) + mixed(words[i : i + n], 1)
    return out


def band_keys(shingles: np.ndarray) -> dict[int, list[np.ndarray]]:
    """By window size, for each band the keys of the windows that start at each position."""
    minima = {k: mixed(shingles, 10 + k) for k in range(BANDS * ROWS)}
    out, width = {}, 1
    for size, _, _ in SIZES:
        while width < size:
            minima = {k: np.minimum(m[: max(0, len(m) - width)], m[width:]) for k, m in minima.items()}
            width *= 2
        out[size] = [mixed(minima[b * ROWS] * np.uint64(3) + minima[b * ROWS + 1], 50 + b) for b in range(BANDS)]
    return out


class Index:
    """Band keys of the templates' windows."""

    MASK = (1 << 20) - 1

    def __init__(self, templates: dict[str, tuple[str, str]]):
        self.words = {name: words for name, (_, text) in templates.items() if (words := words_of(text))}
        self.width = {name: min(SHINGLE, len(w)) for name, w in self.words.items()}
        self.shingles = {name: {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} for name, w in self.words.items() for k in [self.width[name]]}
        self.maybe: dict[tuple[int, int, int], np.ndarray] = {}
        self.names: dict[tuple[int, int, int, int], set[str]] = {}
        for name, words in self.words.items():
            width = self.width[name]
            n = len(words) - width + 1
            size = max(s for s, _, least in SIZES if n >= least)
            for b, keys in enumerate(self.keys(word_hashes(words), width)[size]):
                self.maybe.setdefault((width, size, b), np.zeros(self.MASK + 1, bool))[keys & np.uint64(self.MASK)] = True
                for k in keys.tolist():
                    self.names.setdefault((width, size, b, k), set()).add(name)

    @staticmethod
    def keys(words: np.ndarray, width: int) -> dict[int, list[np.ndarray]]:
        shingles = shingle_hashes(words, width)
        return band_keys(shingles) if width == SHINGLE else {1: [shingles]}

    def retrieve(self, words: np.ndarray) -> list[tuple[int, str]]:
        """(position of a window, template) by the bands; positions are in shingles."""
        found = set()
        for width in set(self.width.values()):
            for size, bands in self.keys(words, width).items():
                stride = next(st for s, st, _ in SIZES if s == size)
                for b, keys in enumerate(bands):
                    if (width, size, b) not in self.maybe:
                        continue
                    own = keys[::stride]
                    for i in np.flatnonzero(self.maybe[width, size, b][own & np.uint64(self.MASK)]).tolist():
                        for name in self.names.get((width, size, b, int(own[i])), ()):
                            found.add((i * stride, name))
        return sorted(found)

    def verify(self, words: list[str], at: int, name: str, least: float, after: int = 0) -> tuple[int, int, float] | None:
        """(first word, end word, containment) of the template around a window, not before word `after`, or None."""
        want, n, width = self.shingles[name], len(self.words[name]), self.width[name]
        low = max(after, at - n)
        near = words[low : at + 2 * n]
        hits = [i for i in range(len(near) - width + 1) if tuple(near[i : i + width]) in want]
        best = None
        for a in range(len(hits)):  # the best stretch of about the template's length
            inside = [i for i in hits[a:] if i < hits[a] + n - width + 1 + n // 4]
            share = len({tuple(near[i : i + width]) for i in inside}) / len(want)
            if share >= least and (best is None or share > best[2]):
                best = (low + inside[0], low + inside[-1] + width, share)
        return best


@functools.cache
def default_index() -> Index:
    return Index(TEMPLATES)


def find_matches(index: Index, templates: dict[str, tuple[str, str]], words: list[str], places: list[tuple[int, str]], least: float) -> list[tuple[str, str, int, int, float]]:
    """Verified matches (template, license, first word, end word, containment) that do not overlap, the best of those that would."""
    out: dict[tuple[str, int], tuple[str, str, int, int, float]] = {}
    until: dict[str, int] = {}
    for at, name in places:
        end = until.get(name, 0)
        if at < end - index.width[name] + 1:
            continue  # inside a match of this template
        if got := index.verify(words, at, name, least, end):
            out[name, got[0]] = (name, templates[name][0], *got)
            until[name] = got[1]
    kept: list[tuple[str, str, int, int, float]] = []
    starts: list[int] = []
    for m in sorted(out.values(), key=lambda m: (-m[4], m[2] - m[3], m[2], m[0])):
        i = bisect.bisect_left(starts, m[3])  # kept matches that start before its end; the last of them reaches furthest
        if i == 0 or kept[i - 1][3] <= m[2]:
            starts.insert(i, m[2])
            kept.insert(i, m)
    return kept


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, tuple[str, str]] | None = None, least: float = MIN_CONTAINED) -> DataFrame:
    """Per match in docs: doc_id, template, license, start, end (code points, end exclusive), containment."""

    def make():
        used = TEMPLATES if templates is None else templates
        index = default_index() if templates is None else Index(templates)
        gap = np.arange(1, SHINGLE + 16, dtype=np.uint64) << np.uint64(40)  # words that no text has

        def work(cols, texts):
            lists = [words_of(t) for t in texts]
            parts, begin, at = [], [], 0
            for w in lists:
                begin.append(at)
                parts += [word_hashes(w), gap]
                at += len(w) + len(gap)
            # Windows start at multiples of the stride of the whole slice; whichever they are, an occurrence holds one of them.
            places: dict[int, list[tuple[int, str]]] = {}
            for p, name in index.retrieve(np.concatenate(parts)) if parts else []:
                i = int(np.searchsorted(begin, p, "right")) - 1
                places.setdefault(i, []).append((p - begin[i], name))
            rows = []
            for i, own in places.items():
                found = find_matches(index, used, lists[i], own, least)
                if found:
                    spans = [m.span() for m in WORD.finditer(texts[i])]
                    rows += [(i, name, kind, spans[a][0], spans[b - 1][1], share) for name, kind, a, b, share in found]
            return {"doc_id": cols[0].take(pa.array([r[0] for r in rows], pa.int64()))} | {k: [r[j + 1] for r in rows] for j, k in enumerate(["template", "license", "start", "end", "containment"])}

        return work

    return map_texts(docs, [id_col, text_col], f"doc_id {sql_type(docs, id_col)}, template string, license string, start bigint, end bigint, containment double", make)
