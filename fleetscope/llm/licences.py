"""Licence scan: a trained paragraph classifier whose findings a template confirms.

Paragraphs are parted by blank lines; those of several lines are read as a whole and
also line by line, as a notice may stand among other lines. Sparse word n-gram logistic
regression, trained in numpy, gives each of these units a licence family or the unknown
class. It learns from whole licence texts and headers (``TEXTS``), their sentences, runs of
words as a line break leaves them, and short notices; the unknown class from a sample of at
most ``SAMPLE`` lines and paragraphs of the corpus that have no word that only licences have,
and from other uses of such words. Probabilities are calibrated by a temperature on what
no training unit has: other licences (``HELD_BACK``), which are unknown, other versions of known
ones, and a part of the corpus units. A unit counts as a licence if the family's calibrated
probability passes ``LEAST``; it is confirmed if ``CONFIRM`` of its word pairs stand in one of
the family's texts, or of a short notice's pairs in it.

Nothing is left out before the classifier. As it is linear, one number an n-gram, the most
that it can add to any family over the unknown class, bounds a unit's probability from above;
only units that this bound leaves open are given all classes' numbers, and no other can pass.

A paragraph that is a piece of a licence is told as a whole, otherwise its lines are.

Edge cases: a null or empty text has no findings; ids may be null or repeat, each row
is read by itself; an empty table gives an empty result; further columns, of any name, are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetscope.llm.common import flat, id_text, slices, text_bytes
from fleetscope.llm.decontam import _LOWER, window_hashes, words

SAMPLE = 4000
BITS = 16
SIZES = (1, 2, 3)
LEAST = 0.6
CONFIRM = 0.8
#: A unit of fewer words than this is confirmed by short notices only.
FEW = 5
ROUNDS = 150
UNKNOWN = "unknown"
_LETTERS = np.zeros(256, dtype=bool)
_LETTERS[[*range(48, 58), *range(97, 123)]] = True

_NO_WARRANTY = "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD_DISCLAIMER = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT INCLUDING NEGLIGENCE OR OTHERWISE ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."


def _gnu(name: str, version: str, what: str = "program") -> str:
    return f"This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version. This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details. You should have received a copy of the GNU {name} along with this {what}. If not, see https://www.gnu.org/licenses."


#: Whole licences or their headers, by family; fixed values.
TEXTS = {
    "mit": ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _NO_WARRANTY,),
    "apache-2.0": ("Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",),
    "gpl": (_gnu("General Public License", "3"), _gnu("General Public License", "2"), "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    "lgpl": (_gnu("Lesser General Public License", "3", "library"), _gnu("Lesser General Public License", "2.1", "library"), "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    "agpl": (_gnu("Affero General Public License", "3"),),
    "bsd": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _BSD_DISCLAIMER,),
    "isc": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",),
    "boost": ("Boost Software License - Version 1.0. Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement must be included in all copies of the Software, in whole or in part, and all derivative works of the Software.", "Distributed under the Boost Software License, Version 1.0. See accompanying file LICENSE or copy at https://www.boost.org/LICENSE_1_0.txt"),
    "mpl-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",),
    "unlicense": ("This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain.",),
    "cc-by": ("This work is licensed under a Creative Commons Attribution 4.0 International License. To view a copy of this license, visit https://creativecommons.org/licenses/by/4.0/.",),
    "cc-by-sa": ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License. To view a copy of this license, visit https://creativecommons.org/licenses/by-sa/4.0/.",),
    "cc-by-nc": ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License. To view a copy of this license, visit https://creativecommons.org/licenses/by-nc/4.0/.",),
    "cc0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. This work is dedicated to the public domain under CC0 1.0 Universal.",),
    "proprietary": ("All rights reserved. No part of this work may be reproduced, stored or transmitted in any form without the prior written permission of the publisher.", "This document is confidential and proprietary. Unauthorized copying of this file, via any medium, is strictly prohibited."),
}
#: Short notices by family, and identifiers as SPDX has them; fixed values.
NOTICES = {
    "mit": ("released under the mit license", "licensed under the mit license", "mit license", "SPDX-License-Identifier: MIT"),
    "apache-2.0": ("licensed under the apache license version 2.0", "apache license 2.0", "released under apache 2.0", "SPDX-License-Identifier: Apache-2.0"),
    "gpl": ("licensed under the gnu general public license version 3", "licensed under the gnu general public license version 2", "released under the gpl v3", "gnu gpl version 2 or later", "SPDX-License-Identifier: GPL-3.0-or-later", "SPDX-License-Identifier: GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0"),
    "lgpl": ("licensed under the gnu lesser general public license", "released under the lgpl", "SPDX-License-Identifier: LGPL-2.1-or-later", "SPDX-License-Identifier: LGPL-3.0-only"),
    "agpl": ("licensed under the gnu affero general public license", "released under the agpl v3", "SPDX-License-Identifier: AGPL-3.0-or-later"),
    "bsd": ("licensed under the bsd license", "released under the 3-clause bsd license", "bsd 2-clause license", "SPDX-License-Identifier: BSD-3-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    "isc": ("licensed under the isc license", "SPDX-License-Identifier: ISC"),
    "boost": ("distributed under the boost software license", "SPDX-License-Identifier: BSL-1.0"),
    "mpl-2.0": ("licensed under the mozilla public license version 2.0", "released under the mpl 2.0", "SPDX-License-Identifier: MPL-2.0"),
    "unlicense": ("released under the unlicense", "SPDX-License-Identifier: Unlicense"),
    "cc-by": ("licensed under cc by 4.0", "licensed under a creative commons attribution 4.0 license", "SPDX-License-Identifier: CC-BY-4.0"),
    "cc-by-sa": ("licensed under cc by sa 4.0", "licensed under a creative commons attribution sharealike 4.0 license", "SPDX-License-Identifier: CC-BY-SA-4.0"),
    "cc-by-nc": ("licensed under cc by nc 4.0", "licensed under a creative commons attribution noncommercial 4.0 license", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    "cc0": ("dedicated to the public domain under cc0 1.0", "released under cc0", "SPDX-License-Identifier: CC0-1.0"),
    "proprietary": ("all rights reserved", "proprietary and confidential"),
}
LEADS = ("", "this work is", "this file is", "the code is", "this program is", "this text is", "copyright 2020 the authors")
TAILS = ("", "see the license file for details", "or any later version", "by the authors")
#: Other licences (unknown) and other versions of known ones, for calibration only; fixed values.
HELD_BACK = (
    (UNKNOWN, "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented."),
    (UNKNOWN, "This program and the accompanying materials are made available under the terms of the Eclipse Public License which is available at the project's site. Everyone is permitted to copy and distribute verbatim or modified copies of this licence document, and changing it is allowed as long as the name is changed."),
    (UNKNOWN, "The contents of this file are subject to the terms of the Common Development and Distribution License. The package may be distributed under the terms of the Artistic License as described in its documentation."),
    ("bsd", "All advertising materials mentioning features or use of this software must display the following acknowledgement. Redistributions of any form whatsoever must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("gpl", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 1 as published by the Free Software Foundation."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this font software and associated files, to deal in the Software without restriction, including the rights to use, copy, modify and sell copies of the Software."),
    ("cc-by", "This work is licensed under the Creative Commons Attribution 3.0 Unported License."),
    ("apache-2.0", "This product is licensed to you under the Apache License, Version 2.0. You may not use this product except in compliance with the License."),
)
#: Other uses of licences' words, which are unknown.
OTHER_USES = (
    "licensed", "under the license", "license", "copyright", "version 2.0", "version 3", "the software", "permission", "rights", "public", "this work is", "released", "his driving licence was taken away", "the poet takes a licence with history", "the licence fee rose again", "he was released under bail by the court", "human rights are reserved for no one",
    "permission was granted by the court to appeal", "the general public was not admitted", "a warranty of two years for the engine", "the foundation published a free report", "software may be slow without more memory", "the author grants an interview", "redistribution of wealth and use of land", "a copy of the letter was found", "the terms of the treaty were published", "conditions of any kind of weather", "the notice shall be read in all villages",
)
#: Words that only licence units have; no unit with one of them teaches the unknown class.
MARKS = re.compile(r"licen[cs]|copyright|rights reserved|public domain|creative commons|warrant|redistribut|spdx", re.I)


class Units:
    """The units of some texts: their n-grams' buckets, where each unit's words begin and end, its text and place."""

    def __init__(self, texts: list[bytes]):
        data, offsets = flat(texts)
        low = _LOWER[data]
        start, end, mark, self.of_word = words(low, offsets, _LETTERS)
        self.low, self.start, self.end = low, start, end
        # A word's line, counted over all texts, and whether a blank line lies before it.
        line_end = np.flatnonzero(data == 10)
        line = np.searchsorted(line_end, start) + self.of_word
        content = (data > 32).astype(np.int64)
        total = np.r_[0, np.cumsum(content)]
        edges = np.r_[0, line_end + 1]
        blank_line = total[np.r_[line_end, len(data)]] == total[edges] if len(data) else np.ones(1, dtype=bool)
        blanks = np.r_[0, np.cumsum(blank_line)]
        paragraph = blanks[np.searchsorted(line_end, start)] + self.of_word * (len(line_end) + 2)
        number = np.searchsorted(line_end, start) - np.searchsorted(line_end, offsets[:-1])[self.of_word]
        lines, paragraphs = self._runs(line), self._runs(paragraph)
        # Paragraphs of one line are that line.
        several = line[paragraphs[:, 0]] != line[paragraphs[:, 1] - 1] if len(paragraphs) else np.zeros(0, dtype=bool)
        self.spans = np.concatenate([lines, paragraphs[several]]) if len(start) else np.zeros((0, 2), dtype=np.int64)
        self.whole = np.r_[np.zeros(len(lines), dtype=bool), np.ones(int(several.sum()), dtype=bool)]
        self.text, self.line = (x[self.spans[:, 0]] if len(start) else np.zeros(0, dtype=np.int64) for x in (self.of_word, number))
        self.last_line = number[self.spans[:, 1] - 1] if len(start) else np.zeros(0, dtype=np.int64)
        self.buckets = {n: (window_hashes(mark, n) >> np.uint64(64 - BITS)).astype(np.int64) for n in SIZES}

    @staticmethod
    def _runs(key: np.ndarray) -> np.ndarray:
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
        return np.stack([first, np.r_[first[1:], len(key)]], axis=1).astype(np.int64) if len(key) else np.zeros((0, 2), dtype=np.int64)

    def sums(self, value: np.ndarray, which: np.ndarray) -> np.ndarray:
        """The sum of ``value[bucket]`` over the n-grams of each of the units ``which``."""
        out = np.zeros(len(which))
        a, b = self.spans[which].T
        for n, at in self.buckets.items():
            total = np.r_[0.0, np.cumsum(value[at])]
            last = np.minimum(np.maximum(b - n + 1, a), len(total) - 1)
            out += np.where(b - a >= n, total[last] - total[np.minimum(a, last)], 0.0)
        return out

    def sizes(self, which: np.ndarray) -> np.ndarray:
        long = np.diff(self.spans[which])[:, 0]
        return sum(np.maximum(long - n + 1, 0) for n in SIZES)

    def words_of(self, k: int) -> list[bytes]:
        a, b = self.spans[k]
        return [self.low[self.start[i] : self.end[i]].tobytes() for i in range(a, b)]

    def entries(self) -> tuple[np.ndarray, np.ndarray]:
        """All n-grams' buckets and their units, for units that are whole texts of one line."""
        found, of = [], []
        for n, at in self.buckets.items():
            place = np.arange(len(at))
            same = self.of_word[place] == self.of_word[place + n - 1]
            found.append(at[same])
            of.append(self.of_word[place[same]])
        return np.concatenate(found), np.concatenate(of)


def _cut(text: str, rng: np.random.Generator, times: int) -> list[str]:
    """Runs of a text's words as line breaks leave them."""
    own = text.split()
    out = []
    for _ in range(times):
        n = int(rng.integers(7, 16))
        at = int(rng.integers(0, max(1, len(own) - n + 1)))
        out.append(" ".join(own[at : at + n]))
    return out


def examples(rng: np.random.Generator) -> tuple[list[str], list[str]]:
    rows, names = [], []
    for family, texts in TEXTS.items():
        own = list(texts)
        for text in texts:
            sentences = re.split(r"(?<=[.:;]) ", text)
            own += [x for x in sentences if len(x.split()) > 4] + _cut(text, rng, 20 + len(text.split()))
        own += [f"{lead} {notice} {tail}" for notice in NOTICES[family] for lead in LEADS for tail in TAILS]
        rows += own
        names += [family] * len(own)
    return rows, names


class Classifier:
    """Logistic regression with one class a family and the unknown class, and its temperature."""

    def __init__(self, unknown: list[str], seed: int = 3):
        rng = np.random.default_rng(seed)
        self.classes = [UNKNOWN, *TEXTS]
        rows, names = examples(rng)
        held = rng.random(len(unknown)) < 0.2
        rows += [*OTHER_USES, *(x for x, h in zip(unknown, held) if not h)]
        names += [UNKNOWN] * (len(rows) - len(names))
        apart = [(UNKNOWN, x) for x, h in zip(unknown, held) if h]
        for family, text in HELD_BACK:
            apart += [(family, x) for x in [text, *_cut(text, rng, 12)]]
        self._fit(Units([" ".join(x.split()).encode() for x in rows]), np.array([self.classes.index(n) for n in names]))
        y = np.array([self.classes.index(n) for n, _ in apart])
        z = self.logits(Units([" ".join(x.split()).encode() for _, x in apart]))
        losses = []
        for t in np.geomspace(0.25, 8, 41):
            q = z / t
            q -= q.max(1, keepdims=True)
            losses.append((np.log(np.exp(q).sum(1)) - q[np.arange(len(y)), y]).mean())
        self.temperature = float(np.geomspace(0.25, 8, 41)[int(np.argmin(losses))])
        #: The most that an n-gram adds to a family over the unknown class.
        self.most = (self.weights[:, 1:] - self.weights[:, :1]).max(1)
        self.least = LEAST_GAP * self.temperature - float((self.bias[1:] - self.bias[0]).max())

    def _fit(self, units: Units, y: np.ndarray) -> None:
        at, of = units.entries()
        n, m = len(y), len(self.classes)
        value = 1 / np.sqrt(np.maximum(np.bincount(of, minlength=n), 1))[of]
        used, at = np.unique(at, return_inverse=True)
        order = np.argsort(at, kind="stable")
        by_gram, first = of[order], np.searchsorted(at[order], np.arange(len(used)))
        by_text = np.argsort(of, kind="stable")
        heads = np.flatnonzero(np.r_[True, np.diff(of[by_text]) > 0])
        which = of[by_text][heads]
        w, b = np.zeros((len(used), m), dtype=np.float32), np.zeros(m, dtype=np.float32)
        balance = (n / m / np.maximum(np.bincount(y, minlength=m), 1))[y].astype(np.float32)
        speed = [np.zeros_like(w), np.zeros_like(b)]
        v = value.astype(np.float32)[:, None]
        for _ in range(ROUNDS):
            z = np.tile(b, (n, 1))
            z[which] += np.add.reduceat(w[at[by_text]] * v[by_text], heads, axis=0)
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(n), y] -= 1
            p *= (balance / n)[:, None]
            grad = np.add.reduceat(p[by_gram] * v[order], first, axis=0) + 1e-5 * w
            speed = [0.9 * s - 5.0 * g for s, g in zip(speed, (grad, p.sum(0)))]
            w, b = w + speed[0], b + speed[1]
        self.weights, self.bias = np.zeros((1 << BITS, m)), b.astype(np.float64)
        self.weights[used] = w

    def logits(self, units: Units, which: np.ndarray | None = None) -> np.ndarray:
        which = np.arange(len(units.spans)) if which is None else which
        scale = np.sqrt(np.maximum(units.sizes(which), 1))
        return np.stack([units.sums(self.weights[:, c], which) / scale for c in range(len(self.classes))], axis=1) + self.bias

    def classify(self, units: Units) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Units that have a family, its number and its probability."""
        every = np.arange(len(units.spans))
        bound = units.sums(self.most, every) / np.sqrt(np.maximum(units.sizes(every), 1))
        open_ = every[bound >= self.least - 1e-9]
        z = self.logits(units, open_) / self.temperature
        p = np.exp(z - z.max(1, keepdims=True)) if len(z) else z
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1) if len(p) else np.zeros(0, dtype=np.int64)
        sure = (best > 0) & (p[np.arange(len(p)), best] >= LEAST)
        return open_[sure], best[sure], p[np.arange(len(p)), best][sure]


#: How far a family must be above the unknown class for a probability of ``LEAST``.
LEAST_GAP = float(np.log(LEAST / (1 - LEAST)))


def _pairs(own: list[bytes]) -> frozenset:
    return frozenset(zip(own, own[1:]))


def _split(text: str) -> list[bytes]:
    return re.findall(rb"[a-z0-9]+", text.lower().encode())


_TEXT_PAIRS = {family: [_pairs(_split(t)) for t in texts] for family, texts in TEXTS.items()}
_NOTICE_PAIRS = {family: [_pairs(_split(t)) for t in notices] for family, notices in NOTICES.items()}


def text_share(own: list[bytes], family: str) -> float:
    """Share of the unit's word pairs that one of the family's texts holds; few words are no share."""
    pairs = _pairs(own)
    return max(len(t & pairs) / len(pairs) for t in _TEXT_PAIRS[family]) if len(own) >= FEW else 0.0


def similarity(own: list[bytes], family: str) -> float:
    """The share of the unit in a text of the family, or of a notice's pairs that the unit holds."""
    pairs = _pairs(own)
    return max(text_share(own, family), *(len(t & pairs) / len(t) for t in _NOTICE_PAIRS[family]))


def find(model: Classifier, texts: list[bytes]) -> list[list[dict]]:
    """The findings of each text, by line.

    A paragraph that is a piece of a licence's text is told as a whole, and its lines aren't; any other paragraph
    only if none of its lines is told, as when a notice is broken in two.
    """
    units = Units(texts)
    rows = []
    for k, family, p in zip(*(x.tolist() for x in model.classify(units))):
        known, own = model.classes[family], units.words_of(k)
        alike = similarity(own, known)
        rank = 1 if not units.whole[k] else 0 if text_share(own, known) >= CONFIRM else 2
        rows.append((int(units.text[k]), rank, int(units.line[k]), {"line": int(units.line[k]), "last": int(units.last_line[k]), "family": known, "probability": p, "similarity": alike, "confirmed": alike >= CONFIRM}))
    out: list[list[dict]] = [[] for _ in texts]
    for text, rank, _, x in sorted(rows, key=lambda r: r[:3]):
        meets = [y for y in out[text] if y["line"] <= x["last"] and x["line"] <= y["last"]]
        if not meets or (rank == 2 and x["confirmed"] and not any(y["confirmed"] for y in meets)):
            out[text].append(x)
    return [sorted(x, key=lambda f: (f["line"], f["last"])) for x in out]


def train(docs: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Classifier:
    """The classifier; its unknown class learns from at most ``sample`` units, those with the least hashes of one unit a document."""
    rows = id_text(docs, id_col, text_col)

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        for batch in batches:
            for part in slices(batch):
                found = []
                for text in part.column("text").to_pylist():
                    mark = zlib.crc32(text.encode())
                    own = [x for x in (re.split(r"\n\s*\n", text) if mark % 4 == 0 else text.split("\n")) if x.strip() and not MARKS.search(x)]
                    found += [" ".join(own[mark // 4 % len(own)].split()[:200])] if own else []
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], ["unit"])

    found = rows.mapInArrow(units, "unit string").distinct().orderBy(F.xxhash64("unit"), "unit").limit(sample)
    return Classifier(sorted(x["unit"] for x in found.collect()))


_FINDING = pa.struct([("line", pa.int32()), ("last", pa.int32()), ("family", pa.string()), ("probability", pa.float64()), ("similarity", pa.float64()), ("confirmed", pa.bool_())])


def scan(docs: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, findings``: for each licence unit its first and last line, family, probability, similarity and whether it is confirmed."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = find(shared.value, text_bytes(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, pa.list_(_FINDING))], ["doc_id", "findings"])

    return id_text(docs, id_col, text_col).mapInArrow(look, "doc_id long, findings array<struct<line:int,last:int,family:string,probability:double,similarity:double,confirmed:boolean>>")
