"""License scans: MinHash bands over overlapping windows retrieve templates, containment verifies.

Texts and templates become hashes of five-word shingles. A template belongs to the largest
window of WINDOWS that it fills. Every window of a template, at every offset, is in a small
broadcast table of band hashes; a text is read in windows that overlap by three quarters.
A verbatim passage holds a window equal to a template's, or nearly so: at the worst offset
the two share 7/9 of their shingles, and at that similarity the eight bands of two find it
with probability 0.9994; single-shingle windows are found always. A retrieved template is a
match if a window of the text, at most a quarter longer than the template, holds at least 80 in
100 of its shingles; copies are found one after the other, each with its own row. Of a license's
templates that match in one place the largest counts, so a full text is one row and not one for
each notice in it.

Defined results: one row for each match, in any order: a text without one has no row, and
null and empty texts have none; spans count words from 0, end exclusive; rows with equal or
null ids are scanned one by one; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from tabulon.llm.common import small_batches, table
from tabulon.llm.near_dup import _mix

WORDS = 5
CONTAINED = 80
#: The longest window that a copy may take, in lengths of its template.
REACH = 1.25
WINDOWS = (16, 4, 1)
BANDS, ROWS = 8, 2
CACHE_WORDS = 500_000
#: Texts that are hashed as one.
TOGETHER = 64

ORACLE_SQL = None

#: License, and a notice that names or grants it, or its full text. Wording of public licenses.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    # full texts
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."),
    ("WTFPL", "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed."),
]

_WORD = re.compile(rb"[a-z0-9\x80-\xff]+(?:\.[0-9]+)*")
_STEP = np.uint64(0x9E3779B97F4A7C15)
_HASHES: dict[bytes, int] = {}


def shingle_row(text: bytes | None) -> np.ndarray:
    """Hashes of the five-word shingles of a text, in order. Words are runs of letters and
    digits, A-Z lower-cased, with version numbers kept whole."""
    words = _WORD.findall(text.lower()) if text else []
    if len(words) < WORDS:
        return np.empty(0, dtype=np.uint64)
    known = _HASHES
    if len(known) > CACHE_WORDS:
        known.clear()
    for w in set(words):
        if w not in known:
            known[w] = xxhash.xxh3_64_intdigest(w)
    one = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
    code = np.zeros(len(one) - WORDS + 1, dtype=np.uint64)
    for k in range(WORDS):
        code = _mix(code * _STEP + one[k : len(one) - WORDS + 1 + k])
    return code


def window_bands(code: np.ndarray, window: int) -> list[np.ndarray]:
    """For each band, the hash of every window of so many shingles."""
    out, band = [], None
    for k in range(BANDS * ROWS):
        low = _mix(code + np.uint64((k + 1) * int(_STEP) % (1 << 64)))
        step = 1
        while step < window:
            low = np.minimum(low[:-step], low[step:])
            step *= 2
        band = low if k % ROWS == 0 else _mix(band * _STEP + low)
        if k % ROWS == ROWS - 1:
            out.append(band)
        if window == 1 and out:
            break  # the window is its shingle
    return out


class Templates:
    """Band table and shingle sets of the templates."""

    def __init__(self, templates: list[tuple[str, str]]) -> None:
        rows = [(name, shingle_row(text.encode())) for name, text in templates]
        self.rows = [(name, np.unique(code)) for name, code in rows if len(code)]
        self.tables: dict[int, list[tuple[np.ndarray, dict[int, set[int]]]]] = {}
        for at, (_, code) in enumerate((n, c) for n, c in rows if len(c)):
            window = next(w for w in WINDOWS if w <= len(code))
            bands = window_bands(code, window)
            table = self.tables.setdefault(window, [(np.zeros(1 << 16, dtype=bool), {}) for _ in bands])
            for (marks, owners), values in zip(table, bands, strict=True):
                marks[values & np.uint64(0xFFFF)] = True
                for v in values.tolist():
                    owners.setdefault(v, set()).add(at)

    def candidates(self, codes: list[np.ndarray]) -> list[dict[int, list[int]]]:
        """For each row of shingles, template to the windows' places that it may be at.

        All rows are hashed as one; windows that would cross from one into the next are left out.
        """
        sizes = np.array([len(c) for c in codes], dtype=np.int64)
        code = np.concatenate(codes) if codes else np.empty(0, dtype=np.uint64)
        starts = np.cumsum(sizes) - sizes
        start, end = np.repeat(starts, sizes), np.repeat(starts + sizes, sizes)
        at_all = np.arange(len(code))
        found: list[dict[int, set[int]]] = [{} for _ in codes]
        for window, table in self.tables.items():
            if len(code) < window:
                continue
            step = max(1, window // 4)
            # the last window of a row is read too, wherever it starts
            places = np.flatnonzero(((at_all - start) % step == 0) & (at_all + window <= end) | (at_all + window == end) & (at_all >= start))
            for (marks, owners), values in zip(table, window_bands(code, window), strict=True):
                values = values[places]
                for k in np.flatnonzero(marks[values & np.uint64(0xFFFF)]).tolist():
                    if owned := owners.get(int(values[k])):
                        place = int(places[k])
                        row = int(np.searchsorted(starts, place, side="right")) - 1
                        for at in owned:
                            found[row].setdefault(at, set()).add(place - int(starts[row]))
        return [{at: sorted(p) for at, p in one.items()} for one in found]

    def scan(self, texts: list[bytes | None]) -> list[list[tuple[str, int, int, float]]]:
        """License, span in words, and contained share of every match of each text."""
        codes = [shingle_row(t) for t in texts]
        return [self._matches(code, places) for code, places in zip(codes, self.candidates(codes), strict=True)]

    def _matches(self, code: np.ndarray, candidates: dict[int, list[int]]) -> list[tuple[str, int, int, float]]:
        """One match a copy: of matches of one license that overlap, the one with the most shingles."""
        found: dict[str, list[tuple[int, int, int, float]]] = {}
        for at, places in candidates.items():
            name, wanted = self.rows[at]
            for low, high, share in copies(code, wanted, places):
                found.setdefault(name, []).append((-round(share * len(wanted)), low, high, share))
        out = []
        for name, matches in found.items():
            taken: list[tuple[int, int]] = []
            for _, low, high, share in sorted(matches):
                if all(high <= a or low >= b for a, b in taken):
                    taken.append((low, high))
                    out.append((name, low, high + WORDS - 1, share))
        return sorted(out)


def copies(code: np.ndarray, wanted: np.ndarray, places: list[int]) -> list[tuple[int, int, float]]:
    """(first shingle, end, share) of each copy of the shingles wanted (sorted, distinct) near the places.

    A copy is the first window of at most REACH times the template that holds CONTAINED in 100 of its
    shingles, moved on as long as that adds some; the next copy starts after its last shingle.
    """
    size, width = len(wanted), max(1, int(REACH * len(wanted)))
    need = -(-CONTAINED * size // 100)
    out: list[tuple[int, int, float]] = []
    done = 0
    for place in places:
        if place < done:
            continue
        # a window that holds a copy found at this place starts no earlier than its own length before it
        low, high = max(done, place - width), min(len(code), place + 2 * width)
        row = code[low:high]
        number = np.searchsorted(wanted, row)
        number[(number == size) | (wanted[np.minimum(number, size - 1)] != row)] = -1
        spots = np.flatnonzero(number >= 0).tolist()
        which = number.tolist()
        count, held, first, start = [0] * size, 0, 0, None
        best, best_span = 0, (0, 0)
        for k, spot in enumerate(spots):
            count[which[spot]] += 1
            held += count[which[spot]] == 1
            # what lies too far back leaves the window, and what is repeated later has no part in the copy
            while spot - spots[first] >= width or count[which[spots[first]]] > 1:
                count[which[spots[first]]] -= 1
                held -= count[which[spots[first]]] == 0
                first += 1
            if held >= need and start is None:
                start = spots[first]
            if start is not None:
                if spots[first] > start + width - need:
                    break
                if held > best:
                    best, best_span = held, (spots[first], spots[k] + 1)
        if best:
            out.append((low + best_span[0], low + best_span[1], best / size))
            done = low + best_span[1]
    return out


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """doc_id, license, start_word, end_word and contained of every match."""
    shared = docs.sparkSession.sparkContext.broadcast(Templates(templates))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = shared.value.scan
        for batch in batches:
            rows = []
            ids, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()
            for k in range(0, len(ids), TOGETHER):
                for doc_id, matches in zip(ids[k : k + TOGETHER], scan(texts[k : k + TOGETHER]), strict=True):
                    rows += [(doc_id, *m) for m in matches]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "license", "start_word", "end_word", "contained"])

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, license string, start_word bigint, end_word bigint, contained double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
