"""License scans: winnowed fingerprints of templates in an inverted index, then banded alignment of words."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from importlib.resources import files

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import small_batches

# Public license texts and customary notices.
TEMPLATES: dict[str, tuple[str, str]] = {
    "mit": ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    "mit-disclaimer": ("MIT", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    "mit-notice": ("MIT", "Released under the MIT License."),
    "apache-2.0": ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    "apache-2.0-notice": ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    "gpl-3.0": ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    "gpl-3.0-notice": ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    "bsd-3-clause": ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    "bsd-2-clause": ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    "unlicense": ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    "gpl-2.0": ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    "lgpl-2.1": ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."),
    "agpl-3.0": ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details."),
    "isc": ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "mpl-2.0": ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    "cc-by-nc-4.0-notice": ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    "cc-by-sa-4.0": ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "cc-by-4.0": ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
}

#: Full texts beside this module: the file's name is the license, "-text" is added to name the template.
FOLDER = "templates"

#: Words of a fingerprint, fingerprints of a window of which the least is kept, half width of the alignment band, and
#: least share of a template that must be matched.
GRAM, WINDOW, BAND, COVERAGE = 3, 2, 12, 0.7
#: Share of a template's fingerprints that a place must hold to be aligned, and words between two of them at most.
SHARED, FAR = 0.1, 200
MATCH, MISMATCH, GAP = 2, -1, -1
WORD = re.compile(r"[^\W_]+")


def templates() -> dict[str, tuple[str, str]]:
    """Notices above and full texts: template to (license, text)."""
    full = {f"{f.name[:-4].lower()}-text": (f.name[:-4], f.read_text("utf-8")) for f in files("spanloom.llm").joinpath(FOLDER).iterdir() if f.name.endswith(".txt")}
    return TEMPLATES | dict(sorted(full.items()))


def tokens(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    found = list(WORD.finditer(text))
    return [m[0].lower() for m in found], [m.span() for m in found]


def grams(words: list[str]) -> list[int]:
    return [xxhash.xxh64_intdigest(" ".join(words[i:i + GRAM]).encode()) for i in range(len(words) - GRAM + 1)]


def winnow(h: list[int]) -> list[int]:
    """Positions of the least hash of each window, the rightmost of equals."""
    if len(h) <= WINDOW:
        return sorted({min(range(len(h)), key=lambda i: (h[i], -i))}) if h else []
    return sorted({min(range(i, i + WINDOW), key=lambda j: (h[j], -j)) for i in range(len(h) - WINDOW + 1)})


class Index:
    """Inverted index of the templates' winnowed fingerprints; its size is that of the templates.

    Text and template are winnowed alike, so GRAM + WINDOW - 1 words in common share a fingerprint at least. In a text,
    runs of words that some template has are winnowed, each by itself: no fingerprint lies across other words.
    """

    def __init__(self, texts: dict[str, tuple[str, str]]):
        self.words = {k: tokens(t)[0] for k, (_, t) in texts.items()}
        self.vocabulary = {w for ws in self.words.values() for w in ws}
        self.at: dict[int, list[tuple[str, int]]] = defaultdict(list)
        self.least: dict[str, float] = {}
        for k, ws in self.words.items():
            h = grams(ws)
            kept = winnow(h)
            self.least[k] = max(1.0, SHARED * len(kept))
            for i in kept:
                self.at[h[i]].append((k, i))

    def candidates(self, words: list[str]) -> dict[str, list[tuple[int, int]]]:
        """template -> (position in the document, position in the template), in order of the document."""
        out: dict[str, list[tuple[int, int]]] = defaultdict(list)
        start, known = None, self.vocabulary
        for i, w in enumerate([*words, ""]):
            if w in known:
                start = i if start is None else start
                continue
            if start is not None and i - start >= GRAM:
                h = grams(words[start:i])
                for j in winnow(h):
                    for k, t in self.at.get(h[j], ()):
                        out[k].append((start + j, t))
            start = None
        return out

    def chains(self, k: str, hits: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
        """Hits that go on within BAND of a diagonal, forward in text and template; a copy that follows starts anew.

        Only the chains that end near a hit are looked at, one a diagonal cell, so this is linear in the hits. In a long
        template a hit that steps back a little is a phrase that comes twice: it neither ends a chain nor moves its end.
        """
        long = len(self.words[k]) > 4 * BAND
        done: list[list[tuple[int, int]]] = []
        open_: dict[int, tuple[list[tuple[int, int]], int, int]] = {}  # chain and its end in text and template
        for d, t in hits:
            cell = (d - t) // BAND
            near = [c for c in (cell, cell - 1, cell + 1) if c in open_ and abs((d - t) - (open_[c][1] - open_[c][2])) <= BAND and d - open_[c][1] <= FAR]
            on = [c for c in near if t > open_[c][2]]
            if on:
                chain = open_.pop(max(on, key=lambda c: len(open_[c][0])))[0]
            elif near and long:
                open_[near[0]][0].append((d, t))
                continue
            else:
                chain = []
                done.append(chain)
            chain.append((d, t))
            open_[cell] = chain, d, t
        joined: list[list[tuple[int, int]]] = []
        for chain in done:  # in order of the text; what a phrase that comes twice has cut goes on where a last one ends
            d, t = chain[0]
            before = [x for x in joined[-8:] if long and t > x[0][1] and chain[-1][1] > x[-1][1] and d - x[-1][0] <= FAR and abs((d - t) - (x[-1][0] - x[-1][1])) <= 2 * BAND]
            if before:
                max(before, key=len).extend(chain)
            elif len(chain) >= (self.least[k] / 8 if long else 1):
                joined.append(chain)
        return [x for x in joined if len(x) >= self.least[k]]

    def scan(self, text: str | None) -> list[tuple[str, float, int, int, int, int]]:
        """(template, coverage, start, end, matched words, template words) of each place; offsets in code points."""
        if not text:
            return []
        words, where = tokens(text)
        found = []
        for k, hits in self.candidates(words).items():
            template, free = self.words[k], list(words)
            todo = self.chains(k, hits)
            while todo:
                chain = todo.pop()
                lo, hi = min(d - t for d, t in chain) - BAND, max(d - t for d, t in chain) + BAND
                at = max(0, lo)  # the words that the band reaches, and no others
                got = align(template, free[at:max(at, hi + len(template))], lo - at, hi - at)
                if got and got[2] >= COVERAGE * len(template):
                    s, e = at + got[0], at + got[1]
                    found.append((k, got[2] / len(template), where[s][0], where[e - 1][1], got[2], len(template)))
                    free[s:e] = [""] * (e - s)
                    # short copies may follow one another within the band
                    todo += self.chains(k, [x for x in chain if not s <= x[0] < e])
        starts: list[int] = []
        ends: list[int] = []
        best = []
        for x in sorted(set(found), key=lambda x: (-x[4], -x[1], x[2], x[0])):  # of overlapping places the most words
            i = bisect_left(starts, x[3])  # places from i on start behind this one
            if i == 0 or ends[i - 1] <= x[2]:
                starts.insert(i, x[2])
                ends.insert(i, x[3])
                best.append(x)
        return sorted(best, key=lambda x: x[2])


def align(template: list[str], words: list[str], lo: int, hi: int) -> tuple[int, int, int] | None:
    """Best local alignment with document minus template position in lo..hi: (start, end, matched words)."""
    width = hi - lo + 1
    prev: list[tuple[int, int, int]] = [(0, -1, 0)] * width  # score, start, matched
    best = (0, 0, 0, 0)
    for t, w in enumerate(template):
        now: list[tuple[int, int, int]] = []
        for x in range(width):
            d = t + lo + x
            if not 0 <= d < len(words):
                now.append((0, -1, 0))
                continue
            s, at, m = prev[x]
            same = words[d] == w
            cell = (s + MATCH, at if s > 0 else d, (m if s > 0 else 0) + 1) if same else (s + MISMATCH, at, m)
            if x + 1 < width and prev[x + 1][0] + GAP > cell[0]:
                cell = (prev[x + 1][0] + GAP, prev[x + 1][1], prev[x + 1][2])
            if x and now[x - 1][0] + GAP > cell[0]:
                cell = (now[x - 1][0] + GAP, now[x - 1][1], now[x - 1][2])
            if cell[0] <= 0:
                cell = (0, -1, 0)
            elif same and cell[0] > best[0]:
                best = (cell[0], cell[1], d + 1, cell[2])
            now.append(cell)
        prev = now
    return (best[1], best[2], best[3]) if best[0] else None


def scan(docs: DataFrame, texts: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """(doc_id, license, template, coverage, start, end, n_matched, n_template) for every license text or notice found.

    texts: template to (license, text); templates() if not given. Texts are read whole, in time that grows with their
    length and with the matches in them; null and empty ones hold nothing. Of overlapping places the one with most
    matched words stays, of equals the better covered, then the earlier. A document has as many rows as places; repeated
    rows of docs are scanned each. Other columns are ignored. Empty table: no rows.
    """
    texts = texts or templates()
    small_batches(docs.sparkSession)
    kinds = "template: string, coverage: double, start: int, end: int, n_matched: int, n_template: int"

    @F.pandas_udf(f"array<struct<license: string, {kinds}>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = Index(texts)
        names = ("template", "coverage", "start", "end", "n_matched", "n_template")
        for batch in batches:
            yield pd.Series([[{"license": texts[x[0]][0], **dict(zip(names, x, strict=True))} for x in index.scan(t)] for t in batch])

    return docs.select("doc_id", F.explode(run(F.col("text").cast("string"))).alias("x")).select("doc_id", "x.*")
