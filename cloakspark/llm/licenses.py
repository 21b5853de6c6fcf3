"""License scan: MinHash bands over overlapping windows of texts retrieve templates, exact containment verifies.

A template of n shingles is looked for in windows of 2 s shingles that begin every s, s the least width of at least n: any
copy lies inside one window, so the Jaccard similarity of window and template is over 1/4 (1/5 where a fifth of the
shingles differ). BANDS bands of one row each meet with a probability of at least 1 - (4/5)**BANDS, 0.9999. A
window that meets a template in a band is a match if it holds enough of the template's shingles.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .common import U64, batches, mix, pick, word_hashes

K = 3
BANDS = 42
CONTAINMENT = 0.8
#: Shingles between the beginnings of the narrowest windows; each further width doubles it.
WIDTH = 2
#: Characters of text that a task scans at once.
AT_ONCE = 1 << 21

#: Widely used notices and the operative parts of widely used licenses.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "all-rights-reserved": "All rights reserved.",
}

_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256))
_A = mix(np.arange(1, BANDS + 1, dtype=U64) * U64(0x5851F42D4C957F2D)) | U64(1)
_W = [U64(pow(0xD6E8FEB86659FD93, i + 1, 1 << 64)) for i in range(K)]


def shingles(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of K words (letters and digits, A-Z in lower case), and how many each text has."""
    h, counts = word_hashes([b"" if t is None else t.encode("utf-8", "surrogatepass").translate(_PLAIN) for t in texts])
    n = np.maximum(counts - K + 1, 0)
    if len(h) < K:
        return np.zeros(0, dtype=U64), n
    with np.errstate(over="ignore"):
        s = mix(sum(h[i : len(h) - K + 1 + i] * w for i, w in enumerate(_W)))
    first = np.repeat(np.cumsum(counts) - counts - (np.cumsum(n) - n), n)
    return s[np.arange(len(first)) + first], n


class Templates:
    def __init__(self, texts: dict[str, str]):
        self.names = sorted(texts)
        s, n = shingles([texts[k] for k in self.names])
        self.sets = [np.unique(x) for x in np.split(s, np.cumsum(n)[:-1])]
        if any(len(x) == 0 for x in self.sets):
            raise ValueError(f"a template needs {K} words")
        self.level = [max(0, int(np.ceil(np.log2(len(x) / WIDTH)))) for x in self.sets]
        self.keys: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        self.tables: dict[tuple[int, int], np.ndarray] = {}
        with np.errstate(over="ignore"):
            for lv in set(self.level):
                own = [t for t, at in enumerate(self.level) if at == lv]
                for b in range(BANDS):
                    least = np.array([(self.sets[t] * _A[b]).min() for t in own], dtype=U64)
                    order = np.argsort(least)
                    self.keys[lv, b] = (least[order], np.array(own)[order])
                    self.tables[lv, b] = np.zeros(1 << 16, dtype=bool)
                    self.tables[lv, b][least >> U64(48)] = True

    def scan(self, s: np.ndarray, n: np.ndarray) -> list[tuple[int, int, float, int, int]]:
        """(text, template, containment, first shingle, windows) of all texts' matches."""
        if not len(s):
            return []
        owner = np.flatnonzero(n)
        ends = np.cumsum(n)
        begins = ends - n
        chunks = -(-n[owner] // WIDTH)
        doc = np.repeat(owner, chunks)
        inner = np.arange(len(doc)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
        starts = begins[doc] + inner * WIDTH
        levels = range(max(self.level) + 1)
        plan = []  # for each level: document and number of each chunk, whether the next one is the same document's
        d, j = doc, inner
        for lv in levels:
            same = np.concatenate([d[1:] == d[:-1], [False]])
            plan.append((d, j, same))
            keep = np.flatnonzero(j % 2 == 0)
            d, j = d[keep], j[keep] // 2
        found = set()
        with np.errstate(over="ignore"):
            for b in range(BANDS):
                m = np.minimum.reduceat(s * _A[b], starts)
                for lv in levels:
                    d, j, same = plan[lv]
                    after = np.where(same, np.concatenate([m[1:], m[-1:]]), m)
                    w = np.minimum(m, after)
                    if (lv, b) in self.keys:
                        keys, own = self.keys[lv, b]
                        hit = np.flatnonzero(self.tables[lv, b][w >> U64(48)])
                        for i in hit:
                            lo, hi = np.searchsorted(keys, w[i], "left"), np.searchsorted(keys, w[i], "right")
                            found.update((int(d[i]), int(own[k]), int(j[i]), lv) for k in range(lo, hi))
                    m = w[j % 2 == 0]
        best: dict[tuple[int, int], list] = {}
        for i, t, j, lv in sorted(found):
            width = WIDTH << lv
            a = begins[i] + j * width
            window = s[a : min(a + 2 * width, ends[i])]
            held = np.isin(window, self.sets[t])
            share = len(np.unique(window[held])) / len(self.sets[t])
            if share >= CONTAINMENT:
                at = int(a - begins[i] + np.flatnonzero(held)[0])
                have = best.setdefault((i, t), [0.0, at, 0])
                have[:] = [max(have[0], share), min(have[1], at), have[2] + 1]
        return [(i, t, share, at, count) for (i, t), (share, at, count) in sorted(best.items())]


def scan(docs: DataFrame, templates: dict[str, str] | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, license, containment, first_word, windows: a row for each document row and template that it holds.

    containment is the best window's share of the template's distinct shingles, first_word the number (from 0) of the
    first word of a shared shingle, windows how many matched. Texts of fewer than three words, null and empty ones have
    no row; rows that repeat an id have rows each; a template inside another one is reported too; a null id stays null; an
    empty table gives an empty one; other columns are left behind.
    """
    texts = dict(TEMPLATES if templates is None else templates)
    d = pick(docs, doc=id_col, text=text_col)

    def run(parts):
        index = Templates(texts)
        for pdf in parts:
            rows, keys, own = [], pdf["doc"].tolist(), pdf["text"].tolist()
            for a, b in batches([len(t) if t else 0 for t in own], AT_ONCE):
                rows += [(keys[a + i], index.names[t], share, at, count) for i, t, share, at, count in index.scan(*shingles(own[a:b]))]
            yield pd.DataFrame(rows, columns=["doc_id", "license", "containment", "first_word", "windows"])

    if not texts:
        return d.selectExpr("doc AS doc_id", "'' AS license", "double(0) AS containment", "0L AS first_word", "0L AS windows").limit(0)
    Templates(texts)  # what is wrong with them is said here, not in a task
    return d.mapInPandas(run, f"doc_id {d.schema['doc'].dataType.simpleString()}, license string, containment double, first_word long, windows long")
