"""License scans: MinHash bands over overlapping windows find templates, exact shingle containment verifies them.

Texts and templates become shingles of five words. A window is a quarter longer than a template and the next one begins
an eighth of a template further on, so that some window holds all of a notice wherever it stands. Windows and templates
are compared by BANDS bands of ROWS MinHash values: a window that contains 0.8 of a template's shingles has a Jaccard
similarity of at least 0.8 / (1.25 + 0.2) = 0.55 with it, and the two share a band with a probability of more than
1 - (1 - 0.55^2)^24 = 0.9998. What shares a band is verified by counting shingles.

Identifiers in SPDX lines are shorter than a shingle and are read as they stand.

Windows without any template's shingle cannot share a band with any and are left out from the start.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .decontaminate import Words, _Table
from .rows import as_bytes, slices

SHINGLE, CONTAINMENT, BANDS, ROWS = 5, 0.8, 24, 2
SLICE = 1 << 20
_U = np.uint64

#: Wording of public licenses and of the notices that name them.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    (
        "Apache-2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    ),
    ("GPL-3.0", "licensed under the GNU General Public License, version 3"),
    ("GPL-2.0", "licensed under the GNU General Public License, version 2"),
    ("LGPL-3.0", "licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "licensed under the GNU Affero General Public License, version 3"),
    ("MPL-2.0", "subject to the terms of the Mozilla Public License, v. 2.0"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License"),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License"),
    (
        "BSD",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    ),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0"),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0"),
    *((f"CC-{k}-4.0", f"licensed under {a} Creative Commons {name} 4.0 International License") for k, name in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives")) for a in ("a", "the")),
    ("MIT", "distributed under the terms of the MIT license"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means"),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at"),
    ("CC0-1.0", "has waived all copyright and related or neighboring rights to"),
    ("Zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"),
)

#: An SPDX line: identifiers, joined by operators.
_SPDX = re.compile(rb"\bSPDX-License-Identifier:[ \t]*([(]*[A-Za-z0-9.+-]+[)]*(?:[ \t]+(?:OR|AND|WITH)[ \t]+[(]*[A-Za-z0-9.+-]+[)]*)*)")
_NAMED = re.compile(rb"(WITH[ \t]+)?([A-Za-z0-9][A-Za-z0-9.+-]*)")
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def spdx(text: bytes | None) -> list[tuple[str, int, int]]:
    """(license, first word, number of words) of the identifiers in SPDX lines, exactly as written; exceptions are none."""
    out: list[tuple[str, int, int]] = []
    at, words = 0, 0
    for m in _SPDX.finditer(text) if text and b"SPDX-License-Identifier:" in text else ():
        words += len(_WORD.findall(text, at, m.start()))
        at, n = m.start(), len(_WORD.findall(m[0]))
        out += [(name.decode(), words, n) for name in dict.fromkeys(k for w, k in _NAMED.findall(m[1]) if not w and k not in (b"OR", b"AND"))]
    return out


def shingles(words: Words) -> np.ndarray:
    """Hash of the five words from each position on; of no text's end."""
    for n, gram in words.grams():
        if n == SHINGLE:
            return gram
    return np.zeros(0, np.uint64)


class LicenseIndex:
    """Templates with their shingles and their MinHash bands."""

    def __init__(self, templates=TEMPLATES):
        words = Words([t.encode() for _, t in templates])
        if len(templates) and words.count.min() < SHINGLE:
            raise ValueError(f"a template needs {SHINGLE} words")
        gram = shingles(words)
        self.names = [n for n, _ in templates]
        self.grams = [gram[a : b - SHINGLE + 1] for a, b in zip(words.first, words.last, strict=True)]
        self.sets = [frozenset(g.tolist()) for g in self.grams]
        every = np.unique(np.concatenate(self.grams)) if self.grams else np.zeros(0, np.uint64)
        self.table = _Table(every, np.arange(len(every)))
        rng = np.random.default_rng(7)
        self.times = rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * _U(2) + _U(1)
        self.plus = rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
        self.by_size: dict[int, dict[tuple, list[int]]] = {}
        for k, g in enumerate(self.grams):
            bands = self.by_size.setdefault(len(g), {})
            for band in self.bands(g):
                bands.setdefault(band, []).append(k)

    def bands(self, gram: np.ndarray) -> list[tuple]:
        h = gram[:, None] * self.times + self.plus
        least = (h ^ (h >> _U(31))).min(axis=0).reshape(BANDS, ROWS)
        return [(b, *row) for b, row in enumerate(least.tolist())]

    def scan(self, texts: list[bytes | None]) -> list[list[tuple[str, int, int]]]:
        """Of each text: (license, first word, number of words) of the windows that contain a template."""
        words, out = Words(texts), [[] for _ in texts]
        gram = shingles(words)
        if not len(gram):
            return out
        valid = np.flatnonzero(words.starts(SHINGLE))
        known = valid[[k for k, _ in self.table.hits(gram[valid])]]
        owner = np.searchsorted(words.last, known, side="right")
        for d in np.unique(owner).tolist():
            first, last = int(words.first[d]), int(words.last[d]) - SHINGLE + 1
            out[d] = self._scan_text(gram[first:last], known[owner == d] - first)
        return out

    def _scan_text(self, gram: np.ndarray, known: np.ndarray) -> list[tuple[str, int, int]]:
        best: dict[tuple[str, int], tuple[float, int, int]] = {}
        for size, bands in self.by_size.items():
            width, stride = size + size // 4, max(1, size // 8)
            starts = {max(0, s) for p in known.tolist() for s in range((p - width) // stride * stride, p + 1, stride) if s > p - width}
            tried = set()
            for a in sorted(starts):
                for k in {k for band in self.bands(gram[a : a + width]) for k in bands.get(band, ())}:
                    region = a // max(width, 1), k
                    found = self._contained(gram, k, max(0, a - stride), a + width + stride, width)
                    if found and region not in tried:
                        tried.add(region)
                        # the first window that suffices may hold the beginning only; the rest of it follows
                        whole = self._contained(gram, k, max(0, a - stride), a + 2 * width + stride, width)
                        share, start, n = whole if whole and whole[1] < found[1] + found[2] else found
                        key = self.names[k], start
                        best[key] = max(best.get(key, (0.0, 0, 0)), (share, n, start))
        rows = [(name, start, n, share) for (name, start), (share, n, _) in best.items()]
        # of licenses found at one place only those stay that no other one fits better
        spans = sorted((name, a, n) for name, a, n, share in rows if not any(a < b + m and b < a + n and other > share for _, b, m, other in rows))
        out: list[tuple[str, int, int]] = []
        for name, start, n in spans:  # overlapping windows of one license are one place
            if out and out[-1][0] == name and start < out[-1][1] + out[-1][2]:
                a = out[-1][1]
                out[-1] = (name, a, max(out[-1][2], start + n - a))
            else:
                out.append((name, start, n))
        return out

    def _contained(self, gram: np.ndarray, k: int, a: int, b: int, width: int) -> tuple[float, int, int] | None:
        """The best window of the region that contains enough of template k: share, first word, number of words."""
        wanted, part = self.sets[k], gram[a:b].tolist()
        inside: Counter = Counter()
        best = (0, 0)
        for j, g in enumerate(part):
            if g in wanted:
                inside[g] += 1
            if j >= width and part[j - width] in wanted:
                inside[part[j - width]] -= 1
                if not inside[part[j - width]]:
                    del inside[part[j - width]]
            if len(inside) > best[0]:
                best = len(inside), j
        share = best[0] / len(wanted)
        if share < CONTAINMENT:
            return None
        hit = [j for j in range(max(0, best[1] - width + 1), best[1] + 1) if part[j] in wanted]
        return share, a + hit[0], hit[-1] - hit[0] + SHINGLE


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES) -> DataFrame:
    """(doc_id, licenses array<string>, places array<struct<license,first_word,n_words>>) of every document.

    Words are runs of a-z (A-Z in lower case), 0-9 and characters beyond ASCII. A null or empty text has no licenses.
    Repeated rows are judged alike; an empty table gives an empty result; other columns are ignored. Texts are read
    once and never shuffled; the templates, a fixed list, go to every worker. SPDX lines, shorter than a shingle mostly,
    name their licenses exactly, whatever the templates.
    """
    place = pa.struct([("license", pa.string()), ("first_word", pa.int32()), ("n_words", pa.int32())])
    shared = docs.sparkSession.sparkContext.broadcast(LicenseIndex(tuple(templates)))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, size=SLICE):
            texts = as_bytes(batch.column(1))
            found = [f + spdx(t) for f, t in zip(shared.value.scan(texts), texts, strict=True)]
            names = pa.array([sorted({n for n, _, _ in f}) for f in found], pa.list_(pa.string()))
            places = pa.array([[{"license": n, "first_word": a, "n_words": m} for n, a, m in f] for f in found], pa.list_(place))
            yield pa.RecordBatch.from_arrays([batch.column(0), names, places], names=["doc_id", "licenses", "places"])

    id_type = docs.select(F.col(id_col)).schema[0].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(kernel, f"doc_id {id_type}, licenses array<string>, places array<struct<license:string,first_word:int,n_words:int>>")
