"""Licence scan: Dice coefficient over word bigrams against templates.

Texts are normalised to lower-case words of ASCII letters, digits and non-ASCII bytes.  For a template of m words
every window of m words of a text is a candidate (a shorter text is one window).  Size bounds prune: a Dice
coefficient of at least d needs so many bigrams of the template inside the window, and a running sum of such
bigrams over the text, taken only where a text has that many at all, leaves few windows to compute exactly.  Where
the windows of two licences overlap, the one that is more alike counts.

The set: Apache-2.0, MIT, ISC, BSD-2-Clause and BSD-3-Clause, MPL-2.0, GPL-2.0 and -3.0, LGPL-2.1 and -3.0, AGPL-3.0,
three Creative Commons licences and the Unlicense, by their notices or standard headers, not by their full texts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..shipping import ship
from .common import slices, text_bytes

#: Licence notices by SPDX-like name.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "LGPL-2.1": ["This work is licensed under the GNU Lesser General Public License, version 2.1.", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "BSD-2-Clause": ["Released under the BSD 2-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."],
    "BSD-3-Clause": ["Released under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}
#: The least Dice coefficient of a match.
LEAST = 0.9
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c > 127 else 32 for c in range(256))


def normalised(text: bytes) -> list[bytes]:
    return text.translate(_PLAIN).split()


def _bigrams(words: list) -> Counter:
    return Counter(zip(words, words[1:], strict=False)) if len(words) > 1 else Counter([tuple(words)])


class Scanner:
    def __init__(self, templates: dict[str, list[str]], least: float):
        self.least = least
        self.ids: dict[bytes, int] = {}
        self.items = []  # (name, words, bigrams)
        for name in sorted(templates):
            for text in templates[name]:
                w = normalised(text.encode())
                for x in w:
                    self.ids.setdefault(x, len(self.ids))
                self.items.append((name, w, _bigrams(w)))
        self.n = len(self.ids) + 1  # the last number: any other word
        self.table = np.zeros((len(self.items), self.n * self.n), bool)
        for k, (_, _, grams) in enumerate(self.items):
            for g in grams:
                if len(g) == 2:
                    self.table[k, self.ids[g[0]] * self.n + self.ids[g[1]]] = True
        self.any = self.table.any(0)

    def scan(self, text: bytes) -> list[tuple[str, float, int, int]]:
        """(licence, Dice, first word, words) of the best window of each licence found."""
        words = normalised(text)
        best: dict[str, tuple[float, int, int]] = {}
        if len(words) < 2:
            for name, w, _ in self.items:
                if words == w:
                    best[name] = (1.0, 0, 1)
            return [(n, *v) for n, v in sorted(best.items())]
        other = self.n - 1
        ids = np.fromiter((self.ids.get(w, other) for w in words), np.int64, len(words))
        pairs = ids[:-1] * self.n + ids[1:]
        if not self.any[pairs].any():
            return []
        for k, (name, w, grams) in enumerate(self.items):
            m = len(w) - 1
            size = min(m, len(pairs))
            need = self.least * (m + size) / 2
            hit = self.table[k, pairs]
            if hit.sum() < need or size < need:
                continue
            run = np.concatenate([[0], np.cumsum(hit)])
            for at in np.flatnonzero(run[size:] - run[:-size] >= need):
                inside = _bigrams(words[at : at + size + 1])
                dice = 2 * sum((inside & grams).values()) / (m + size)
                if dice >= self.least and (name not in best or (-dice, at, size + 1) < (-best[name][0], best[name][1], best[name][2])):
                    best[name] = (dice, int(at), size + 1)
        apart: list[tuple[str, float, int, int]] = []
        for name, (dice, at, size) in sorted(best.items(), key=lambda x: (-x[1][0], -x[1][2], x[0])):
            if all(at + size <= a or a + n <= at for _, _, a, n in apart):
                apart.append((name, dice, at, size))
        return apart


FOUND = "doc_id long, licence string, dice double, n_licences int, matches array<struct<licence:string,dice:double,first_word:int,n_words:int>>"
_MATCH = pa.list_(pa.struct([("licence", pa.string()), ("dice", pa.float64()), ("first_word", pa.int32()), ("n_words", pa.int32())]))


def scan_licences(docs: DataFrame, templates: dict[str, list[str]] | None = None, least: float = LEAST) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text): the best licence found, its Dice coefficient, and all matches.

    Words of a text are those of its normalised form, over lines.  Matches stand in the order of their coefficients,
    ties by more words, then by name; of overlapping windows the first in this order stays; of a licence's windows
    the best, then the leftmost, then the shorter.  Cases: null and empty texts match nothing (licence null, dice 0);
    texts of any length are scanned whole; null doc_ids and repeated rows are rows like others; other columns are
    ignored; no rows give no rows.
    """
    ship(docs.sparkSession)
    which = templates or TEMPLATES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(which, least)
        for b in slices(batches, "text"):
            found = [scanner.scan(t) if t else [] for t in text_bytes(b.column("text"))]
            top = [f[0] if f else (None, 0.0) for f in found]
            rows = [[dict(zip(("licence", "dice", "first_word", "n_words"), x, strict=True)) for x in f] for f in found]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([t[0] for t in top], pa.string()), pa.array([t[1] for t in top], pa.float64()), pa.array([len(f) for f in found], pa.int32()), pa.array(rows, _MATCH)], names=["doc_id", "licence", "dice", "n_licences", "matches"])

    return docs.select("doc_id", "text").mapInArrow(run, FOUND)
