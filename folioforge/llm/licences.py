"""Licence scans: Dice coefficient over word bigrams between stretches of normalised text and licence templates.

Text and templates are normalised alike: lower-case words, nothing else. With B the bag of a template's bigrams and A that of a
stretch of text, Dice is 2 |A and B| / (|A| + |B|). For Dice of at least t a stretch must share at least
t |B| / (2 - t) bigrams with the template and hold at most (2 - t) |B| / t; templates that a text can't match by these bounds are
pruned before any Dice is taken. Bigrams of all templates are looked for in one vectorised search a text, so a text
that shares none costs no more. A stretch begins and ends at a shared bigram; the first that reaches t is trimmed to its best
Dice, and the search goes on after it. Where stretches of several templates overlap, the one with the larger Dice is reported (ties: more bigrams, then the name).

Defined cases: null, empty and one-word texts match nothing, and an empty table gives no rows. Texts are read whole: of a text of any length each shared bigram is looked at
once for each template before any Dice is taken. Repeated rows are each scanned, with their doc_id whatever it is. Columns of `keep` named like one that is made raise ValueError; others are
passed on or not read. Offsets are code points of the original.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from folioforge.llm.common import U64, WordIds, mix64, own_names, slices, texts_as_bytes
from folioforge.llm.decontamination import normalised_words, original_spans

THRESHOLD = 0.8

# Short notices by which texts name their licence, {} standing for the name, and the names.
NOTICES = (
    "Licensed under the {}.",
    "Released under the {}.",
    "This work is licensed under the {}.",
    "This program is licensed under the {}.",
    "Distributed under the {}.",
)
NAMES = {
    "Apache-2.0": ["Apache License, Version 2.0"],
    "MIT": ["MIT License"],
    "ISC": ["ISC License"],
    "BSD-2-Clause": ["BSD 2-Clause License"],
    "BSD-3-Clause": ["BSD 3-Clause License"],
    "GPL-2.0": ["GNU General Public License, version 2"],
    "GPL-3.0": ["GNU General Public License, version 3"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3"],
    "MPL-2.0": ["Mozilla Public License, version 2.0"],
    "CC-BY-4.0": ["Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-ND-4.0": ["Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "CC-BY-NC-SA-4.0": ["Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1"],
    "EPL-2.0": ["Eclipse Public License, version 2.0"],
    "CC0-1.0": ["Creative Commons Zero v1.0 Universal License"],
}
SHORT_NAMES = {"CC-BY-4.0": "CC BY 4.0", "CC-BY-SA-4.0": "CC BY-SA 4.0", "CC-BY-NC-4.0": "CC BY-NC 4.0", "CC-BY-ND-4.0": "CC BY-ND 4.0", "CC-BY-NC-SA-4.0": "CC BY-NC-SA 4.0"}

# Texts of licences and of the headers that they prescribe.
TEXTS = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE
OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL
WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE
FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in
writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express
or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "GPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in
the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR
PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this
program. If not, see https://www.gnu.org/licenses/.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed
with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "GPL-2.0": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as
published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in
the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR
PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this
program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.""",
    "LGPL-2.1": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is
distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A
PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public
License along with this library; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA""",
    "LGPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is
distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A
PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public
License along with this program. If not, see https://www.gnu.org/licenses/.""",
    "AGPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public
License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is
distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A
PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. You should have received a copy of the GNU Affero General Public
License along with this program. If not, see https://www.gnu.org/licenses/.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile,
sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any
means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the
software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We
intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
DEALINGS IN THE SOFTWARE. For more information, please refer to https://unlicense.org""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any
damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial
applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be
misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product
documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented
as being the original software. 3. This notice may not be removed or altered from any source distribution.""",
    "BSL-1.0": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying
documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare
derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The
copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer,
must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative
works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT
WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE
AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY,
WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in
the documentation and/or other materials provided with the distribution. {disclaimer}""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in
the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its
contributors may be used to endorse or promote products derived from this software without specific prior written permission. {disclaimer}""",
}
DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER
OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE,
EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""


def templates() -> list[tuple[str, str]]:
    """(licence, text) of all templates: full texts and headers, and every notice with every name."""
    out = [(name, text.replace("{disclaimer}", DISCLAIMER)) for name, text in TEXTS.items()]
    out += [(name, notice.format(title)) for name, titles in NAMES.items() for title in titles for notice in NOTICES]
    out += [(name, notice.format(title).replace("the CC", "CC")) for name, title in SHORT_NAMES.items() for notice in NOTICES]
    return out


def bigrams(ids: np.ndarray) -> np.ndarray:
    return mix64(ids[:-1] * U64(0x9E3779B97F4A7C15) + mix64(ids[1:])) if len(ids) > 1 else ids[:0]


class Templates:
    def __init__(self, found: list[tuple[str, str]], threshold: float):
        self.names, self.threshold = [n for n, _ in found], threshold
        ids = WordIds()
        self.bags = [Counter(bigrams(ids.of(normalised_words(t.encode()))).tolist()) for _, t in found]
        self.sizes = [b.total() for b in self.bags]
        self.least = [-(-threshold * n // (2 - threshold)) for n in self.sizes]
        self.most = [int((2 - threshold) * n / threshold) for n in self.sizes]
        self.all = np.unique(np.array([x for b in self.bags for x in b], dtype=U64))
        self.holders: dict[int, list[int]] = {}
        for t, bag in enumerate(self.bags):
            for x in bag:
                self.holders.setdefault(x, []).append(t)

    def matches(self, grams: np.ndarray) -> list[tuple[float, int, int, int]]:
        """(Dice, template, first and last bigram), not overlapping, by place."""
        at = np.searchsorted(self.all, grams)
        at[at == len(self.all)] = 0
        hits = np.flatnonzero(self.all[at] == grams) if len(self.all) else at[:0]
        if not len(hits):
            return []
        places: dict[int, list[int]] = {}
        values = grams[hits].tolist()
        for p, x in zip(hits.tolist(), values, strict=True):
            for t in self.holders[x]:
                places.setdefault(t, []).append(p)
        found = []
        for t, own in places.items():
            if len(own) >= self.least[t]:
                found += self.stretches(t, np.array(own), grams)
        taken: list[tuple[float, int, int, int]] = []
        for m in sorted(found, key=lambda m: (-m[0], -self.sizes[m[1]], self.names[m[1]], m[2])):
            if all(m[3] < a or b < m[2] for _, _, a, b in taken):
                taken.append(m)
        return sorted(taken, key=lambda m: m[2])

    def stretches(self, t: int, own: np.ndarray, grams: np.ndarray) -> list[tuple[float, int, int, int]]:
        out, free = [], 0
        for s in self.starts(t, own, grams):
            if s < free:
                continue
            dice, e = self.best(t, own, grams, s)
            if dice < self.threshold:
                continue
            while s + 1 < e and (better := self.best(t, own, grams, s + 1))[0] > dice:
                s, (dice, e) = s + 1, better
            out.append((dice, t, int(own[s]), int(own[e])))
            free = e + 1
        return out

    def starts(self, t: int, own: np.ndarray, grams: np.ndarray) -> list[int]:
        """Shared bigrams from which a stretch of the largest size holds as many of the template's as one must, each as often as the template has it: one pass with two ends."""
        bag, least, most = self.bags[t], self.least[t], self.most[t]
        values, places = grams[own].tolist(), own.tolist()
        held: Counter = Counter()
        shared, z, out = 0, 0, []
        for s, x in enumerate(values):
            while z < len(places) and places[z] < places[s] + most:
                v = values[z]
                held[v] += 1
                shared += held[v] <= bag[v]
                z += 1
            if shared >= least:
                out.append(s)
            shared -= held[x] <= bag[x]
            held[x] -= 1
        return out

    def best(self, t: int, own: np.ndarray, grams: np.ndarray, s: int) -> tuple[float, int]:
        """The largest Dice of a stretch from the s-th shared bigram, and its end; the shortest such."""
        bag, size, start = self.bags[t], self.sizes[t], int(own[s])
        got: Counter = Counter()
        shared, dice, end = 0, 0.0, s
        for e in range(s, len(own)):
            length = int(own[e]) - start + 1
            if length > self.most[t]:
                break
            x = int(grams[own[e]])
            got[x] += 1
            shared += got[x] <= bag[x]
            if (now := 2 * shared / (length + size)) > dice:
                dice, end = now, e
        return dice, end


def from_folder(folder: str) -> tuple[tuple[str, str], ...]:
    """(licence, text) of the files of a folder, each named like its licence: full texts of the long licences, which aren't kept here."""
    return tuple((p.name.removesuffix(".txt"), p.read_text(encoding="utf-8", errors="replace")) for p in sorted(Path(folder).iterdir()) if p.is_file() and not p.is_symlink())


@cache
def built(threshold: float, more: tuple[tuple[str, str], ...] = ()) -> Templates:
    return Templates(templates() + list(more), threshold)


def licences(documents: DataFrame, keep: list[str] | None = None, threshold: float = THRESHOLD, more: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """The kept columns, licence, dice, start, end: one row a stretch of text that matches a template. No shuffle. more: (licence, text) besides the own ones, as of from_folder."""
    keep = ["doc_id"] if keep is None else keep
    own_names(keep, ["licence", "dice", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, known = WordIds(), built(threshold, more)
        for b in slices(batches):
            rows, made = [], []
            for i, raw in enumerate(texts_as_bytes(b.column("text"))):
                found = known.matches(bigrams(ids.of(normalised_words(raw))))
                if found:
                    spans = original_spans(raw.decode("utf-8"), [(a, z + 1) for _, _, a, z in found])
                    for (dice, t, _, _), (start, end) in zip(found, spans, strict=True):
                        rows.append(i)
                        made.append((known.names[t], dice, start, end))
            kept = b.take(pa.array(rows, pa.int32()))
            columns = [pa.array([m[n] for m in made], t) for n, t in enumerate((pa.string(), pa.float64(), pa.int32(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([*(kept.column(c) for c in keep), *columns], [*keep, "licence", "dice", "start", "end"])

    made = [StructField("licence", StringType()), StructField("dice", DoubleType()), StructField("start", IntegerType()), StructField("end", IntegerType())]
    return documents.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, StructType([documents.schema[c] for c in keep] + made))
