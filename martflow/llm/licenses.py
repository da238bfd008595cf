"""Licence texts and notices in documents, by the Dice coefficient of word bigrams.

Texts and templates are normalised alike: ASCII letters in lower case, everything but
ASCII letters, digits and characters beyond ASCII as a gap between words.  The passages
of a document are its lines, its runs of lines without a blank one, the whole text, and
its windows: the runs of words that begin and end with a bigram of the template, over
any lines, and lie inside none of the other passages that match.
``dice = 2 * common / (bigrams of the passage + bigrams of the template)`` over distinct
bigrams; a passage of one word has no bigram and matches nothing.  Of windows that
overlap, the most that can stand side by side are counted.

A template can reach ``threshold`` t only if the smaller of both sizes is t / (2 - t) of
the larger or more, and a passage only if t / 2 of its bigrams occur in some template;
the rest is never compared.  A window needs t / (2 - t) of the template's bigrams and has
at most (2 - t) / t as many of its own; a text without the former is not searched.

Cases: a null or empty text matches nothing; the best match wins, ties to the smaller
template name; rows that repeat a ``doc_id`` count each; an empty table gives no row.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martflow.llm.common import slices
from martflow.llm.license_texts import TEXTS
from martflow.llm.words import bounds, mix, words_of

_BSD_TERMS = """
Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_DISCLAIMER = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF
THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""

# The texts of common licences and the notices by which works name them.
TEMPLATES = {
    "Apache-2.0 header": """
        Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
        with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless
        required by applicable law or agreed to in writing, software distributed under the License is distributed on an
        "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
        specific language governing permissions and limitations under the License.""",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted "
    "provided that the following conditions are met:" + _BSD_TERMS + _BSD_DISCLAIMER,
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted "
    "provided that the following conditions are met:" + _BSD_TERMS + """
        Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
        products derived from this software without specific prior written permission.""" + _BSD_DISCLAIMER,
    "BSD-3-Clause notice": "Licensed under the BSD 3-Clause License.",
    "CC-BY-4.0 notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-4.0 short notice": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0 notice": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0 notice": "To the extent possible under law, the author has waived all copyright and related or "
    "neighboring rights to this work.",
    "GPL-2.0 notice": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0 header": """
        This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
        Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
        option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY
        WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU
        General Public License for more details. You should have received a copy of the GNU General Public License
        along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": """
        Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE
        IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
        WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
        INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,
        WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE
        USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "MIT": """
        Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation
        the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and
        to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above
        copyright notice and this permission notice shall be included in all copies or substantial portions of the
        Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
        LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT
        SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION
        OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
        DEALINGS IN THE SOFTWARE.""",
    "MIT notice": "Released under the MIT License.",
    "MPL-2.0 header": """
        This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was
        not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "Rights reserved": "All rights reserved.",
    "Unlicense": """
        This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish,
        use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any
        purpose, commercial or non-commercial, and by any means.""",
} | TEXTS


def _normal_bytes() -> np.ndarray:
    table = np.full(256, 32, dtype=np.uint8)
    table[128:] = np.arange(128, 256)
    for c in range(128):
        if chr(c).isalnum():
            table[c] = ord(chr(c).lower())
    table[10] = 10
    return table


_NORMAL = _normal_bytes()


def normal(text: str) -> bytes:
    """The text with one space between words, and line feeds kept."""
    return _NORMAL[np.frombuffer(text.encode(), dtype=np.uint8)].tobytes()


def bigrams(passage: bytes) -> set[tuple[bytes, bytes]]:
    words = passage.split()
    return set(zip(words, words[1:], strict=False))


def dice(a: set, b: set) -> Fraction:
    return Fraction(2 * len(a & b), len(a) + len(b)) if a or b else Fraction(0)


def _pair_hashes(words: np.ndarray) -> np.ndarray:
    return mix(words[0, :-1] * np.uint64(0x9E3779B97F4A7C15) + words[0, 1:])


class Scanner:
    """Templates prepared for a threshold."""

    def __init__(self, templates: dict[str, str], threshold: float):
        self.threshold = Fraction(str(threshold))
        self.templates = {name: bigrams(normal(text)) for name, text in sorted(templates.items())}
        words = [words_of([normal(t).decode()]).hashes for t in templates.values()]
        self.known = np.unique(np.concatenate([_pair_hashes(w) for w in words if w.shape[1] > 1]))
        self.names = list(self.templates)
        self.member = np.zeros((len(self.names), len(self.known)), dtype=bool)
        for k, name in enumerate(self.names):
            own = words_of([normal(templates[name]).decode()]).hashes
            if own.shape[1] > 1:
                self.member[k, np.searchsorted(self.known, _pair_hashes(own))] = True
        self.ratio = self.threshold / (2 - self.threshold)
        self.smallest = min(len(b) for b in self.templates.values())
        self.largest = max(len(b) for b in self.templates.values())

    def best(self, passage: bytes) -> tuple[str, Fraction] | None:
        """The best template of a passage, if one reaches the threshold."""
        own, found = bigrams(passage), None
        for name, theirs in self.templates.items():
            small, large = sorted((len(own), len(theirs)))
            if small < self.ratio * large:
                continue
            value = dice(own, theirs)
            if value >= self.threshold and (found is None or value > found[1]):
                found = (name, value)
        return found

    def scan(self, texts: list[str | None]) -> list[tuple[str, Fraction, int] | None]:
        """For each text its best template, the coefficient, and the matching passages."""
        blobs = [normal(t or "") for t in texts]
        blob = b"\n\n".join([*blobs, b""])
        chars = np.frombuffer(blob, dtype=np.uint8)
        found: list[tuple[str, Fraction, int] | None] = [None] * len(texts)
        start, stop = bounds(chars)
        if len(start) < 2:
            return found
        words = words_of([blob.decode(errors="surrogatepass")]).hashes
        pairs = _pair_hashes(words)
        at = np.searchsorted(self.known, pairs)
        hit = self.known[np.minimum(at, len(self.known) - 1)] == pairs
        # Borders: each line feed ends a line, two or more (with gaps) end a block.
        feeds = np.flatnonzero(chars == 10)
        line = np.searchsorted(feeds, start)
        text_edges = np.cumsum([len(b) + 2 for b in blobs])
        text = np.searchsorted(text_edges, start, side="right")
        new_line = line[1:] != line[:-1]
        new_block = (line[1:] - line[:-1] > 1) | (text[1:] != text[:-1])
        lines = np.concatenate(([0], np.cumsum(new_line)))
        blocks = np.concatenate(([0], np.cumsum(new_block)))
        seen: set[tuple[int, int]] = set()
        matched: dict[int, list[tuple[int, int]]] = {}
        for number in (lines, blocks, text):
            inside = number[1:] == number[:-1]
            owner = number[:-1][inside]
            hits = np.bincount(owner, hit[inside], minlength=int(number[-1]) + 1)
            enough = hits >= max(1, np.ceil(float(self.ratio) * self.smallest - 1e-9))
            sel = np.flatnonzero(inside)[enough[owner]]
            own = number[sel]
            key, first = np.unique(mix(pairs[sel] + own.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), return_index=True)
            distinct = np.bincount(own[first], minlength=int(number[-1]) + 1)
            known = np.bincount(own[first], hit[sel][first], minlength=int(number[-1]) + 1)
            fits = (
                (known * 2 >= float(self.threshold) * distinct - 1e-9)
                & (distinct >= float(self.ratio) * self.smallest - 1e-9)
                & (distinct * float(self.ratio) <= self.largest + 1e-9)
                & (distinct > 0)
            )
            for p in np.flatnonzero(fits):
                a, b = np.searchsorted(number, p), np.searchsorted(number, p, side="right")
                span = (int(start[a]), int(stop[b - 1]))
                if span in seen:
                    continue
                seen.add(span)
                match = self.best(blob[span[0] : span[1]])
                if match:
                    i, before = int(text[a]), found[int(text[a])]
                    matched.setdefault(i, []).append((int(a), int(b)))
                    n = 1 + (before[2] if before else 0)
                    if before and (before[1], match[0]) >= (match[1], before[0]):
                        match = before[:2]
                    found[i] = (*match, n)
        self._add_windows(found, matched, pairs, at, hit, text)
        return found

    def _add_windows(self, found: list, matched: dict, pairs: np.ndarray, at: np.ndarray, hit: np.ndarray, text: np.ndarray) -> None:
        """Take the windows of each text into its result."""
        inside = np.flatnonzero(hit & (text[1:] == text[:-1]))
        key = np.unique(text[inside] * np.int64(len(self.known)) + at[inside])
        owner, known = key // len(self.known), key % len(self.known)
        searched: dict[int, list[int]] = {}
        for k, name in enumerate(self.names):
            least = max(1, int(np.ceil(self.ratio * len(self.templates[name]))))
            for i in np.flatnonzero(np.bincount(owner, self.member[k][known], minlength=len(found)) >= least).tolist():
                searched.setdefault(i, []).append(k)
        for i, ks in searched.items():
            a, b = np.searchsorted(text, i), np.searchsorted(text, i, side="right")
            own, n = slice(a, b - 1), int(b - a) - 1
            # The last bigram of the passages that match and begin at a word or before it.
            far = np.full(n + 1, -1, dtype=np.int64)
            for p, q in matched.get(i, ()):
                far[p - a] = max(far[p - a], q - a - 2)
            far = np.maximum.accumulate(far)[:n]
            if far[0] >= n - 1:
                continue
            number = np.unique(pairs[own], return_inverse=True)[1]
            order = np.argsort(number, kind="stable")
            after = np.full(n, n, dtype=np.int64)
            same = number[order][1:] == number[order][:-1]
            after[order[:-1][same]] = order[1:][same]
            spans, best = [], None
            for k in ks:
                member = hit[own] & self.member[k][np.minimum(at[own], len(self.known) - 1)]
                some, top = self._windows(member, after, far, len(self.templates[self.names[k]]))
                spans += some
                if top and (best is None or top > best[1]):
                    best = (self.names[k], top)
            if best is None:
                continue
            count, free = 0, 0
            for stop, first in sorted(spans):
                if first >= free:
                    count, free = count + 1, stop + 2  # a bigram's last word is one further
            before = found[i]
            if before and (before[1], best[0]) >= (best[1], before[0]):
                best = before[:2]
            found[i] = (*best, count + (before[2] if before else 0))

    def _windows(self, member: np.ndarray, after: np.ndarray, far: np.ndarray, m: int) -> tuple[list[tuple[int, int]], Fraction | None]:
        """Of the windows of a text that match a template of ``m`` bigrams: the shortest at
        each start as (last, first bigram), and the best coefficient.  ``member``: bigrams of
        the template; ``after``: the next place of the same bigram."""
        n, t = len(member), self.threshold
        hits = np.flatnonzero(member)
        least, most = int(np.ceil(self.ratio * m)), int(m / self.ratio)
        is_hit, following = member.tolist(), after.tolist()
        # Places in [a, reach) where a bigram first occurs since a, at most one more than fits.
        firsts: list[int] = []
        reach, known, spans, top = 0, 0, [], None
        fresh = np.full(n, -1, dtype=np.int64)
        fresh[after[after < n]] = np.flatnonzero(after < n)
        previous = fresh.tolist()
        for a in range(n):
            while reach < n and len(firsts) <= most:
                if previous[reach] < a:
                    firsts.append(reach)
                    known += is_hit[reach]
                reach += 1
            if is_hit[a] and known >= least and far[a] < n - 1:
                place = np.array(firsts, dtype=np.int64)
                size = np.arange(1, len(place) + 1)
                common = np.cumsum(member[place])
                border = np.append(place[1:], reach if len(place) <= most else place[-1])
                stop = np.append(hits, n)[np.searchsorted(hits, np.maximum(place, far[a] + 1))]
                good = (stop < border) & (2 * common * t.denominator >= t.numerator * (size + m))
                if good.any():
                    at = np.flatnonzero(good)
                    spans.append((int(stop[at].min()), a))
                    x = at[np.argmax(common[at] / (size[at] + m))]
                    top = max(top or Fraction(0), Fraction(2 * int(common[x]), int(size[x]) + m))
            firsts.pop(0)
            known -= is_hit[a]
            if following[a] < reach:
                insort(firsts, following[a])
                known += is_hit[a]
        return spans, top


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """``doc_id, license, dice, n_passages`` of every row; no licence is null."""
    shared = docs.sparkSession.sparkContext.broadcast((templates, threshold))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(*shared.value)
        for batch in slices(batches, "text"):
            found = scanner.scan(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([f and f[0] for f in found], type=pa.string()),
                    pa.array([f and float(f[1]) for f in found], type=pa.float64()),
                    pa.array([f[2] if f else 0 for f in found], type=pa.int64()),
                ],
                names=["doc_id", "license", "dice", "n_passages"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, license string, dice double, n_passages long")
