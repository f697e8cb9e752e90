"""Licence notices by conditional compression.

Around each word of licensing a window of the text is cut, for each class of template lengths its
own. Each template is given to zstandard as a raw dictionary; the window is compressed with and
without it, and templates are ranked by how much smaller the window becomes. In that order they are
compared word by word: an aligned stretch must hold nearly all of the template's words, in order,
with equal numbers and few words between. Of stretches that overlap the one with the most words of
its template wins, then the one with the fewest differences, then the largest reduction. Reductions
decide nothing alone: templates without one are compared too.

A notice must hold a word of licensing (``TRIGGER``), as every template does. Windows have bounded
length and overlap by more than a notice, so that lines and texts of any length are read whole. Null
and empty texts have no notice. Repeated rows give repeated results; a table without rows gives
none. Extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenvec.llm.common import arrow_map

_WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
    "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in "
    "the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
    "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
)
_BSD_OPENING = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_CONDITIONS = (
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
    "materials provided with the distribution."
)
_BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_WARRANTY = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED "
    "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, "
    "INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR "
    "PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
    "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_NOTICE = ", provided that the above copyright notice and this permission notice appear in all copies."
_ISC_WARRANTY = (
    " THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND "
    "FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA "
    "OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_GPL_WARRANTY = (
    " This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
    "PARTICULAR PURPOSE. See the GNU General Public License for more details."
)
#: SPDX identifiers and the wording of public licences and notices (fixed values).
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", _MIT_GRANT),
    ("MIT", _MIT_GRANT + " The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _WARRANTY),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0-only", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0-only", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version." + _GPL_WARRANTY),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version." + _GPL_WARRANTY),
    ("LGPL-2.1-or-later", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD-2-Clause", _BSD_OPENING + " " + _BSD_CONDITIONS + " " + _BSD_WARRANTY),
    ("BSD-3-Clause", _BSD_OPENING + " " + _BSD_CONDITIONS + " " + _BSD_NAMES + " " + _BSD_WARRANTY),
    ("BSD-3-Clause", _BSD_OPENING + " " + _BSD_CONDITIONS + " " + _BSD_NAMES),
    ("LicenseRef-BSD", _BSD_OPENING),
    ("LicenseRef-BSD", "Licensed under the BSD License."),
    ("ISC", _ISC_GRANT + _ISC_NOTICE),
    ("ISC", _ISC_GRANT + _ISC_NOTICE + _ISC_WARRANTY),
    ("0BSD", _ISC_GRANT + "." + _ISC_WARRANTY),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("LicenseRef-All-Rights-Reserved", "All rights reserved."),
)
#: Both Java and Python read it as ASCII.
TRIGGER = r"(?i)licen[sc]|copyright|rights\s+reserved|permi[st]|redistribut|public\s+domain|free\s+software|creative\s+commons|waived|warrant"
_TRIGGER = re.compile(TRIGGER, re.ASCII)
WORD = re.compile(r"\w+(?:[.\-]\w+)*")
#: Share of a template's words that a notice must hold.
LEAST_SHARE = 0.9


def slack(words: int) -> int:
    """Further words that a notice may hold, and places that a word may be out by."""
    return max(2, words // 5)


class Scanner:
    """Ranks templates by compression and confirms by wording; remembers a bounded number of windows."""

    def __init__(self, templates: tuple = TEMPLATES, least_share: float = LEAST_SHARE, most_known: int = 20_000):
        self.templates, self.least_share, self.most_known = templates, least_share, most_known
        self.words = [[w.lower() for w in WORD.findall(t)] for _, t in templates]
        self.places = []
        for words in self.words:
            places: dict[str, list[int]] = {}
            for k, w in enumerate(words):
                places.setdefault(w, []).append(k)
            self.places.append(places)
        self.plain = zstandard.ZstdCompressor(level=3)
        self.primed = []
        for _, t in templates:
            dictionary = zstandard.ZstdCompressionDict(t.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            dictionary.precompute_compress(level=3)
            self.primed.append(zstandard.ZstdCompressor(dict_data=dictionary))
        #: Templates by length, each class up to four times as long as the one before: (words beside a trigger, templates).
        self.classes = []
        for low in (0, 16, 64, 256, 1024):
            own = [k for k, w in enumerate(self.words) if low < len(w) <= max(16, 4 * low)]
            if own:
                longest = max(len(self.words[k]) for k in own)
                self.classes.append((longest + slack(longest), own))
        self.known: dict[tuple, list] = {}

    def reductions(self, words: list[str], templates: list[int]) -> list[tuple[float, int]]:
        """Share of a window's compressed size that each template saves, best first."""
        data = " ".join(words).encode()
        alone = len(self.plain.compress(data))
        return sorted(((1 - len(self.primed[k].compress(data)) / alone, k) for k in templates), key=lambda x: (-x[0], x[1]))

    def confirm(self, words: list[str], k: int) -> list[tuple[int, int, int, int]]:
        """Stretches of ``words`` that hold the template's wording: first, end, words in common, words that differ."""
        there, places = self.words[k], self.places[k]
        m, loose = len(there), slack(len(there))
        offsets = [i - j + m for i, w in enumerate(words) if w in places for j in places[w]]
        if len(offsets) < self.least_share * m:
            return []
        ids = np.array([places[w][0] if w in places else m for w in words])
        wanted = np.bincount([places[w][0] for w in there], minlength=m)
        votes = np.convolve(np.bincount(offsets, minlength=len(words) + m + 1), np.ones(2 * loose + 1, np.int64), "same")
        found: list[tuple[int, int, int, int]] = []
        likely = np.flatnonzero(votes >= self.least_share * m)
        for at in likely[np.argsort(-votes[likely], kind="stable")].tolist():
            low = max(0, at - m - loose)
            end = max(low, at + loose)
            if any(low < b and a < end and min(end, b) - max(low, a) > m // 2 for a, b, *_ in found):
                continue
            # Too few of the words in any order: no stretch can do.
            if np.minimum(np.bincount(ids[low:end], minlength=m + 1)[:m], wanted).sum() < self.least_share * m:
                continue
            here = words[low:end]
            matched = [x for x in SequenceMatcher(None, here, there, autojunk=False).get_matching_blocks() if x.size]
            common = sum(x.size for x in matched)
            if common < self.least_share * m:
                continue
            first, last = matched[0].a, matched[-1].a + matched[-1].size
            extra, inside = last - first - common, set(here[first:last])
            if extra <= loose and all(w in inside for w in there if any(c.isdigit() for c in w)):
                found.append((low + first, low + last, common, m - common + extra))
        return found

    def window(self, words: list[str], templates: list[int]) -> list[tuple[int, int, int, int, float, int]]:
        """Notices of these templates: first, end, words in common, words that differ, reduction, template."""
        key = (templates[0], *words)
        if key not in self.known:
            if len(self.known) >= self.most_known:
                self.known.clear()
            self.known[key] = [(*x, saved, k) for saved, k in self.reductions(words, templates) for x in self.confirm(words, k)]
        return self.known[key]

    def scan(self, text: str) -> list[tuple[int, int, str, float, int]]:
        """Notices of a text: start, end, licence, reduction, differing words; they don't overlap."""
        triggers = [m.start() for m in _TRIGGER.finditer(text)]
        if not triggers:
            return []
        spans = [(m.start(), m.end()) for m in WORD.finditer(text)]
        words = [text[a:b].lower() for a, b in spans]
        starts = [a for a, _ in spans]
        at = sorted({max(0, bisect_right(starts, t) - 1) for t in triggers})
        found = set()
        for reach, templates in self.classes:
            low = end = 0
            regions = []
            for t in at:
                if regions and t - reach <= end:
                    end = regions[-1][1] = min(len(words), t + reach + 1)
                else:
                    low, end = max(0, t - reach), min(len(words), t + reach + 1)
                    regions.append([low, end])
            for low, end in regions:
                while True:
                    stop = min(end, low + 4 * reach)
                    found |= {(a + low, b + low, *rest) for a, b, *rest in self.window(words[low:stop], templates)}
                    if stop == end:
                        break
                    low = stop - 2 * reach
        return [(spans[a][0], spans[b - 1][1], self.templates[k][0], saved, differing) for a, b, _, differing, saved, k in choose(found)]


def choose(found: Iterable[tuple[int, int, int, int, float, int]]) -> list[tuple]:
    """Those of overlapping notices with most words in common, then fewest differences, then largest reduction; in order."""
    chosen: list[tuple] = []
    for x in sorted(found, key=lambda x: (-x[2], x[3], -x[4], x[5], x[0])):
        if all(x[1] <= y[0] or y[1] <= x[0] for y in chosen):
            chosen.append(x)
    return sorted(chosen)


def scan(docs: DataFrame, templates: tuple = TEMPLATES) -> DataFrame:
    """One row for each notice in ``docs (doc_id, text)``: ``doc_id, license, start, length,
    differing_words, reduction, wording``; offsets in code points. No shuffle.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows += [(doc_id, name, a, b - a, d, saved, text[a:b]) for a, b, name, saved, d in scanner.scan(text)]
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                ["doc_id", "license", "start", "length", "differing_words", "reduction", "wording"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return arrow_map(
        rows.filter(F.col("text").rlike(TRIGGER)), run,
        "doc_id long, license string, start long, length long, differing_words long, reduction double, wording string",
    )
