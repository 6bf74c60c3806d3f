"""Licence scans with a trained paragraph classifier.

A paragraph is a run of lines that have words; comment signs and other punctuation are none. Inside it the lines with telling
n-grams make passages: lines that such an n-gram joins, so that a wrapped notice is one passage and notices on lines of their
own are one each. A passage is a sparse bag of word bigrams and trigrams, lower-cased, across line ends. A multinomial logistic regression over the licence families below, a class for licence-like text of none of them (unknown)
and one for all other text (none) scores it. Probabilities are calibrated by a temperature fitted on held-out paragraphs.
A predicted family is confirmed when enough of one of its templates' trigrams stand in the passage's paragraph; an unsure or
unconfirmed prediction becomes unknown. Families, templates and the rule that makes training paragraphs are fixed and
bounded (TRAINING rows); every passage of every text is scored, whole.

The model is a few thousand n-gram hashes with a weight for each class; n-grams that it does not have cost one bit test.

Defined results: null and empty texts have no paragraphs; rows are scanned one by one, so repeated rows repeat their
findings and null ids need no rule; an empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import words
from tidemark.llm.session import small_batches

#: Notices and main paragraphs by which licence families are named in source files and documents.
TEMPLATES = {
    "MIT": (
        "Released under the MIT License.", "Licensed under the MIT License.", "SPDX-License-Identifier: MIT", "This project is licensed under the terms of the MIT license.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "ISC": (
        "Released under the ISC License.", "SPDX-License-Identifier: ISC", "Licensed under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0", "Released under the Apache License 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-or-later", "SPDX-License-Identifier: GPL-2.0-only", "Licensed under the GNU GPL, version 2 or later.", "Released under the GNU General Public License.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    ),
    "LGPL": (
        "Licensed under the GNU Lesser General Public License, version 2.1.", "SPDX-License-Identifier: LGPL-2.1-only",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
    ),
    "AGPL": (
        "Licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-only",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
    ),
    "BSD": (
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "Released under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause", "SPDX-License-Identifier: BSD-2-Clause", "Licensed under the BSD license.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0.", "SPDX-License-Identifier: MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    "EPL-2.0": (
        "Licensed under the Eclipse Public License 2.0.", "SPDX-License-Identifier: EPL-2.0",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License v. 2.0 which is available at https://www.eclipse.org/legal/epl-2.0.",
    ),
    "BSL-1.0": ("Distributed under the Boost Software License, Version 1.0.", "SPDX-License-Identifier: BSL-1.0", "Released under the Boost Software License."),
    "CC-BY": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"),
    "CC-BY-SA": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0"),
    "CC-BY-NC": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    "CC0": ("To the extent possible under law, the author has waived all copyright and related rights to this work.", "Released under CC0 1.0 Universal.", "SPDX-License-Identifier: CC0-1.0"),
    "Unlicense": ("This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    "proprietary": ("All rights reserved.", "All rights reserved. Unauthorized copying of this file is strictly prohibited.", "Proprietary and confidential. All rights reserved.", "This software is the confidential and proprietary information of the owner"),
}
#: Licence-like lines of no family, and lines that only share words with licences.
UNKNOWN = (
    "Licensed under the Example Community License, version 7.", "This work is licensed under the terms agreed with the publisher.", "SPDX-License-Identifier: LicenseRef-Custom", "Released under the Sample Public License.",
    "You may use this file under the conditions of the vendor agreement.", "Permission to use this work is granted by the museum on request.", "Distributed under the Artistic Terms, revision 2.", "Use of this archive is governed by the reading room rules.",
)
OTHER = (
    "The driver lost the license after the accident.", "The general public was invited to visit the new foundation.", "Version 2 of the report was released in the summer.", "The software was installed without any problem.",
    "Copies of the letter are kept in the archive.", "This work is about the life of a painter.", "A free lunch was served under the old tree.", "He granted permission to enter the garden.", "The terms of the treaty were published later.",
    "All rights reserved by the hotel for late guests.", "All rights reserved seats were sold before noon.", "All rights of the citizens are equal under the law.", "The source of the river lies in the mountains.", "Anyone may use the public library free of charge.",
)
PROSE = "the of and to in was is that for it with as his on be at by le la les des du en et une dans der die und das von mit den ein zu el los las una por para con se water stone river light house garden letter evening summer winter music paper street window silver forest".split()

CLASSES = ("none", "unknown", *TEMPLATES)
#: Training paragraphs, and the share of them held out for calibration.
TRAINING, HELD_OUT, SEED = 3_600, 0.25, 5
#: Probability from which a family is believed, and share of a template's trigrams that confirms it.
SURE, CONFIRMED = 0.6, 0.5
BIGRAM, TRIGRAM = 2, 3
#: How much more an n-gram must speak for some licence class than for none to open a passage.
STRONG = 0.15

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
for _c in b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~":
    _LOWER[_c] = 32


def training_paragraphs() -> list[tuple[str, int]]:
    """(paragraph, class) by a seeded rule: notices worn in various ways, licence-like lines, and other text."""
    r = random.Random(SEED)
    prose = lambda n: " ".join(r.choice(PROSE) for _ in range(n))
    out = []

    def worn(line: str) -> str:
        parts = line.split()
        if len(parts) > 10 and r.random() < 0.3:  # a part of it, as of a wrapped line
            n = r.randint(6, len(parts))
            at = r.randint(0, len(parts) - n)
            parts = parts[at : at + n]
        parts = [w for w in parts if r.random() > 0.04]
        return " ".join(filter(None, (prose(r.choice((0, 0, 0, 3, 8, 20))), " ".join(parts), prose(r.choice((0, 0, 0, 3, 8, 20))))))

    for k in range(TRAINING):
        turn = k % 3
        if turn == 0:
            out.append((prose(r.randint(1, 60)) if r.random() < 0.6 else worn(r.choice(OTHER)), 0))
        elif turn == 1 and k % 2:
            out.append((worn(r.choice(UNKNOWN)), 1))
        else:
            c = 2 + r.randrange(len(TEMPLATES))
            out.append((worn(r.choice(TEMPLATES[CLASSES[c]])), c))
    return out


class Grams:
    """Words of a chunk with their line and paragraph (numbered over the chunk), and its bigrams and trigrams.

    A line without words (or with nothing but comment signs) ends a paragraph. n-grams cross lines, not paragraphs.
    """

    def __init__(self, part: words.Chunk):
        self.part = words.Chunk(_LOWER[part.data], part.offsets)
        self.text_of = self.part.text_of
        self.line = np.concatenate(([0], np.cumsum(part.data == 10)))[self.part.starts]  # within a text: less that of its first byte
        self.first_line = np.concatenate(([0], np.cumsum(part.data == 10)))[part.offsets[:-1]]
        fresh = np.ones(len(self.line), bool)
        fresh[1:] = (self.text_of[1:] != self.text_of[:-1]) | (self.line[1:] > self.line[:-1] + 1)
        self.paragraph = np.cumsum(fresh) - 1
        self.row = self.line + self.text_of  # a number for each line, rising by text too
        self.hashes = self.part.hashes()

    def of(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, first word) of each n-gram."""
        found = words.windows(self.hashes, size, 11)
        inside = np.flatnonzero(self.paragraph[: len(found)] == self.paragraph[size - 1 :][: len(found)])
        return found[inside], inside

    def all(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, first word, last word) of each bigram and trigram."""
        (a, p), (b, q) = self.of(BIGRAM), self.of(TRIGRAM)
        return np.concatenate((a, b)), np.concatenate((p, q)), np.concatenate((p + BIGRAM - 1, q + TRIGRAM - 1))


def _grams(lines: list[str]) -> list[np.ndarray]:
    column = pa.array([x.replace("\n", " ") for x in lines])
    out = []
    for low, high, part in words.chunks(column):
        grams = Grams(part)
        hashes, at, _ = grams.all()
        out += [np.unique(hashes[grams.text_of[at] == k]) for k in range(high - low)]
    return out


@dataclass
class Model:
    grams: np.ndarray  # sorted hashes
    weights: np.ndarray  # a row for each gram, a column for each class
    bias: np.ndarray
    temperature: float
    templates: list[tuple[int, np.ndarray]]  # class, trigram hashes

    def __post_init__(self):
        self.strong = self.weights[:, 1:].max(axis=1) - self.weights[:, 0] >= STRONG
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(self.grams & np.uint64(0xFFFF)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Row of each hash, -1 if the model has it not."""
        out = np.full(len(hashes), -1, np.int64)
        likely = np.flatnonzero(self.maybe[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.grams, hashes[likely]), len(self.grams) - 1)
        good = self.grams[at] == hashes[likely]
        out[likely[good]] = at[good]
        return out

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


@cache
def train() -> Model:
    """The classifier, fitted by accelerated gradient steps on the training paragraphs; the same on every call."""
    rows = training_paragraphs()
    bags, classes = _grams([p for p, _ in rows]), np.array([c for _, c in rows])
    held = np.random.default_rng(SEED).random(len(rows)) < HELD_OUT
    grams, seen = np.unique(np.concatenate(bags), return_counts=True)
    grams = grams[seen >= 2]
    x = np.zeros((len(rows), len(grams)), np.float32)
    for k, bag in enumerate(bags):
        at = np.minimum(np.searchsorted(grams, bag), len(grams) - 1)
        x[k, at[grams[at] == bag]] = 1
    y = np.eye(len(CLASSES), dtype=np.float32)[classes]
    fit, n = np.flatnonzero(~held), len(CLASSES)
    w, b = np.zeros((len(grams), n), np.float32), np.zeros(n, np.float32)
    vw, vb, xf, yf = w.copy(), b.copy(), x[fit], y[fit]
    for _ in range(150):
        z = xf @ w + b
        z = np.exp(z - z.max(1, keepdims=True))
        g = z / z.sum(1, keepdims=True) - yf
        vw = 0.9 * vw - 0.5 * (xf.T @ g / len(fit) * 4 + 1e-3 * w)
        vb = 0.9 * vb - 0.5 * g.mean(0)
        w, b = w + vw, b + vb
    logits, target = x[held] @ w + b, classes[held]

    def loss(t: float) -> float:
        z = logits / t - (logits / t).max(1, keepdims=True)
        return float((np.log(np.exp(z).sum(1)) - z[np.arange(len(target)), target]).mean())

    temperature = min((0.25 * 1.1**k for k in range(40)), key=loss)
    kept = np.abs(w).max(1) > 1e-3
    templates = [(CLASSES.index(c), t) for c, lines in TEMPLATES.items() for t in _trigrams(lines)]
    return Model(grams[kept], w[kept].astype(np.float64), b.astype(np.float64), temperature, templates)


def _trigrams(lines: tuple[str, ...]) -> list[np.ndarray]:
    """Distinct trigrams of each line; bigrams where it has fewer than three words."""
    out = []
    for low, high, part in words.chunks(pa.array(lines)):
        grams = Grams(part)
        three, two = grams.of(TRIGRAM), grams.of(BIGRAM)
        for k in range(high - low):
            got = np.unique(three[0][grams.text_of[three[1]] == k])
            out.append(got if len(got) else np.unique(two[0][grams.text_of[two[1]] == k]))
    return out


def passages(grams: Grams, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first row, last row) of the passages that the strong n-grams from words ``start`` to words ``end`` make: lines with such
    an n-gram, joined where one crosses from line to line, so that a wrapped notice is one passage and two notices are two."""
    first, last = grams.row[start], grams.row[end]
    order = np.argsort(first, kind="stable")
    first, last = first[order], np.maximum.accumulate(last[order])
    new = np.ones(len(first), bool)
    new[1:] = first[1:] > last[:-1]
    at = np.flatnonzero(new)
    return first[at], last[np.append(at[1:], len(last)) - 1]


def judge(model: Model, part: words.Chunk) -> Iterator[tuple[int, int, int, int, int, float, float]]:
    """(text, paragraph, line, lines, class, probability, share of the best template) of each licence-like passage of a chunk."""
    grams = Grams(part)
    hashes, start, end = grams.all()
    known = model.find(hashes)
    hit = np.flatnonzero(known >= 0)
    known, start, end = known[hit], start[hit], end[hit]
    strong = model.strong[known]
    if not strong.any():
        return
    low, high = passages(grams, start[strong], end[strong])
    of = np.searchsorted(low, grams.row[start], side="right") - 1
    inside = (of >= 0) & (grams.row[start] <= high[of])
    of, known = of[inside], known[inside]
    order = np.lexsort((known, of))
    of, known = of[order], known[order]
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (known[1:] != known[:-1])  # each n-gram counts once a passage
    of, known = of[new], known[new]
    each, starts = np.unique(of, return_index=True)
    p = model.probabilities(model.bias + np.add.reduceat(model.weights[known], starts, axis=0))
    best = p.argmax(1)
    threes, three_at = grams.of(TRIGRAM)
    twos, two_at = grams.of(BIGRAM)
    beyond: tuple[int, int, int] = (-1, -1, -1)
    for k in np.flatnonzero(best > 0).tolist():
        c, a, b = int(best[k]), int(low[each[k]]), int(high[each[k]])
        word = int(np.searchsorted(grams.row, a))
        text, whole = int(grams.text_of[word]), int(grams.paragraph[word])
        if beyond == (whole, c, a):  # goes on where a passage of the same class ended
            beyond = (whole, c, b + 1)
            continue
        beyond = (whole, c, b + 1)
        span = np.searchsorted(grams.paragraph, (whole, whole + 1))
        here = np.concatenate((threes[slice(*np.searchsorted(three_at, span))], twos[slice(*np.searchsorted(two_at, span))]))
        share = max((float(np.isin(t, here).mean()) for f, t in model.templates if f == c), default=0.0)
        first = int(grams.paragraph[np.searchsorted(grams.text_of, text)])
        yield text, whole - first, a - text - int(grams.first_line[text]), b - a + 1, c, float(p[k, c]), share


COLUMNS = "doc_id long, paragraph long, line long, lines long, predicted string, probability double, template_share double, family string"


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, paragraph, line, lines, predicted, probability, template_share, family) of each licence-like passage.

    paragraph and line (its first) count from 0 within the text; lines is how many it has.
    """
    model = train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 4 + [pa.string(), pa.float64(), pa.float64(), pa.string()]
        for b in batches:
            rows = [(low + text, *rest) for low, _, part in words.chunks(b.column(1)) for text, *rest in judge(model, part)]
            at, paragraph, line, lines, found, p, share = zip(*rows, strict=True) if rows else [()] * 7
            family = [CLASSES[c] if c > 1 and q >= SURE and s >= CONFIRMED else "unknown" for c, q, s in zip(found, p, share, strict=True)]
            columns = [b.column(0).take(pa.array(at, pa.int64())), paragraph, line, lines, [CLASSES[c] for c in found], p, share, family]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) if k else c for k, (c, kind) in enumerate(zip(columns, kinds, strict=True))], names=[c.split()[0] for c in COLUMNS.split(", ")])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, COLUMNS)


def query(spark, sf_dir: str) -> DataFrame:
    """op7: licence-like paragraphs of all documents."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.withColumns({c: F.round(c, 6) for c in ("probability", "template_share")})
