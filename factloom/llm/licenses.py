"""Licence scan: matching statistics of a text against a generalised suffix automaton of licence wordings, chained into spans."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, slices

#: Phrase, label. Their places are counted exactly.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: Wordings, label. Part of a wording is enough for its label, see min_cover.
TEMPLATES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "mit"),
    ("released under the mit license", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache-2"),
    ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "apache-2"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("this work is licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("this work is licensed under a creative commons attribution sharealike 4 0 international license", "cc-by-sa"),
    ("this work is licensed under the gnu general public license version", "gpl"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("under the terms of the gnu lesser general public license as published by the free software foundation", "lgpl"),
    ("under the terms of the gnu affero general public license as published by the free software foundation", "agpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
)

# Whole licence texts and notices.
MIT_TEXT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
BSD_START = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
BSD_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
ISC_TEXT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
ZLIB_TEXT = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
This notice may not be removed or altered from any source distribution."""
UNLICENSE_TEXT = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."""
APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
GPL_NOTICE = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""

#: All wordings, whole texts with them.
WORDINGS = TEMPLATES + (
    (MIT_TEXT, "mit"),
    (BSD_START + " " + BSD_END, "bsd"),
    (BSD_START + " " + BSD_NAMES + " " + BSD_END, "bsd"),
    (ISC_TEXT, "isc"),
    (ZLIB_TEXT, "zlib"),
    (UNLICENSE_TEXT, "unlicense"),
    (APACHE_NOTICE, "apache-2"),
    (GPL_NOTICE, "gpl"),
    (BSD_NAMES, "bsd"),
)

#: Word bytes stay (A-Z in lower case), all others become spaces: words are [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

RESULT = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first:long,last:long,cover:double>>"
_SPANS = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("cover", pa.float64())]))


class Automaton:
    """Generalised suffix automaton: every substring of every wording leads to a state; built one wording after another from the root."""

    def __init__(self, wordings: Sequence[Sequence[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        self.places: list[set] = [set()]  # (wording, end) of occurrences
        self.ends: list[int] = []  # the state of each whole wording
        for w, tokens in enumerate(wordings):
            last = 0
            for i, token in enumerate(tokens):
                last = self._extend(last, token)
                self.places[last].add((w, i + 1))
            self.ends.append(last)
        for v in sorted(range(1, len(self.len)), key=self.len.__getitem__, reverse=True):
            if self.link[v] > 0:
                self.places[self.link[v]] |= self.places[v]

    def _add(self, length: int, following: dict[int, int], link: int) -> int:
        self.next.append(following)
        self.len.append(length)
        self.link.append(link)
        self.places.append(set())
        return len(self.len) - 1

    def _split(self, p: int, q: int, token: int) -> int:
        """A state for the strings of q of at most len(p) + 1 words."""
        copy = self._add(self.len[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, token: int) -> int:
        if token in self.next[last]:  # an earlier wording goes on alike
            q = self.next[last][token]
            return q if self.len[q] == self.len[last] + 1 else self._split(last, q, token)
        new = self._add(self.len[last] + 1, {}, 0)
        p = last
        while p >= 0 and token not in self.next[p]:
            self.next[p][token] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][token]
            self.link[new] = q if self.len[q] == self.len[p] + 1 else self._split(p, q, token)
        return new

    def statistics(self, tokens: Sequence[int]) -> Iterator[tuple[int, int]]:
        """For each place the state and length of the longest wording substring that ends there."""
        state = length = 0
        for token in tokens:
            while state and token not in self.next[state]:
                state = self.link[state]
                length = self.len[state]
            if token in self.next[state]:
                state = self.next[state][token]
                length += 1
            yield state, length


class Scanner:
    def __init__(self, base: Sequence[tuple[str, str]] = BASE, templates: Sequence[tuple[str, str]] = WORDINGS, min_match: int = 3, max_gap: int = 6, min_cover: float = 0.6):
        """min_match: words of the shortest match that counts; max_gap: words between matches that are chained; min_cover: part of a wording that gives its label."""
        texts = [(p, label, True) for p, label in base] + [(t, label, False) for t, label in templates]
        wordings = [t.encode().translate(WORD_BYTES).split() for t, _, _ in texts]
        self.vocab = {w: i for i, w in enumerate(dict.fromkeys(w for x in wordings for w in x))}
        self.wordings = [[self.vocab[w] for w in x] for x in wordings]
        self.labels, self.is_base = [x[1] for x in texts], [x[2] for x in texts]
        self.min_match, self.max_gap, self.min_cover = min(min_match, *(len(w) for w, b in zip(self.wordings, self.is_base, strict=True) if b)), max_gap, min_cover
        self.auto = Automaton(self.wordings)
        n = len(self.vocab)
        self.pairs = np.zeros((n + 1, n + 1), bool)
        for x in self.wordings:
            self.pairs[x[:-1], x[1:]] = True
        #: for each wording the shorter ones that lie in it, and where
        self.inside = [[(v, at) for v, y in enumerate(self.wordings) if len(y) < len(x) and not self.is_base[v] for at in range(len(x) - len(y) + 1) if x[at : at + len(y)] == y] for x in self.wordings]
        phrase_at = {}
        for k, end in enumerate(self.auto.ends):
            if self.is_base[k]:
                phrase_at.setdefault(end, []).append(k)
        #: for each state the base phrases that end where it ends
        self.phrases: list[list[int]] = [[] for _ in self.auto.len]
        for v in sorted(range(1, len(self.auto.len)), key=self.auto.len.__getitem__):
            self.phrases[v] = phrase_at.get(v, []) + self.phrases[self.auto.link[v]]

    def run(self, tokens: Sequence[int], start: int, base: list, matches: list) -> None:
        """Adds (phrase, first word) to base, and (first word, words, state) of each longest match to matches."""
        held = None
        for i, (state, length) in enumerate(self.auto.statistics(tokens)):
            for k in self.phrases[state]:
                size = len(self.wordings[k])
                if size <= length:
                    base.append((k, start + i + 1 - size))
            if held and length <= held[1]:
                if held[1] >= self.min_match:
                    matches.append(held)
            held = (start + i + 1 - length, length, state)
        if held and held[1] >= self.min_match:
            matches.append(held)

    def spans(self, matches: list) -> list[tuple[str, int, int, float]]:
        """Chains of matches that keep a wording's order, each with the part of the wording that it covers."""
        found_in: dict[int, set] = {}
        for first, length, state in matches:
            for w, end in self.auto.places[state]:
                if not self.is_base[w]:
                    found_in.setdefault(w, set()).add((first, length, end))
                    # a long match hides the shorter wordings that lie in it
                    for v, at in self.inside[w]:
                        a, b = max(end - length, at), min(end, at + len(self.wordings[v]))
                        if b - a >= self.min_match:
                            found_in.setdefault(v, set()).add((first + a - end + length, b - a, b - at))
        chains: dict[int, list] = {}
        done = []
        for w, own in found_in.items():
            for first, length, end in sorted(own):
                open_ = chains.get(w)
                # open_: first word, last word + 1, end in the wording, covered words
                if open_ and first - open_[1] <= self.max_gap and end - length >= open_[2] - max(0, open_[1] - first):
                    fresh = min(length, end - open_[2], first + length - open_[1])
                    if fresh > 0:
                        chains[w] = [open_[0], first + length, end, open_[3] + fresh]
                elif not open_ or first - open_[1] > self.max_gap or length > open_[3]:
                    if open_:
                        done.append((w, open_))
                    chains[w] = [first, first + length, end, length]
        done += chains.items()
        found = {(self.labels[w], c[0], c[1] - 1, c[3] / len(self.wordings[w])) for w, c in done}
        return sorted(x for x in found if x[3] >= self.min_cover)

    def scan(self, texts: pa.Array) -> list[pa.Array]:
        words = Words(texts, WORD_BYTES)
        n = len(self.vocab)
        known = np.fromiter((self.vocab.get(w, n) for w in words.distinct), np.int32, len(words.distinct))
        ids = known[words.codes] if len(known) else np.zeros(0, np.int32)
        counts, offsets = words.counts, words.offsets
        # places where two words follow each other in some wording; only runs of those can hold a match of three words or more
        go = self.pairs[ids[:-1], ids[1:]] if len(ids) > 1 else np.zeros(0, bool)
        inner = offsets[1:-1]
        go[inner[(inner > 0) & (inner < len(ids))] - 1] = False
        edges = np.flatnonzero(np.diff(np.concatenate(([0], go.view(np.int8), [0]))))
        starts, ends = edges[::2], edges[1::2] + 1
        keep = ends - starts >= self.min_match
        starts, ends = starts[keep], ends[keep]
        owners = np.searchsorted(offsets, starts, side="right") - 1
        base: dict[int, list] = {}
        matches: dict[int, list] = {}
        for s, e, d in zip(starts.tolist(), ends.tolist(), owners.tolist(), strict=True):
            self.run(ids[s:e].tolist(), s - int(offsets[d]), base.setdefault(d, []), matches.setdefault(d, []))
        rows = []
        for d, size in enumerate(counts.tolist()):
            b, spans = base.get(d, []), self.spans(matches[d]) if d in matches else []
            own = {self.labels[k] for k, _ in b}
            at = [p for _, p in b]
            rows.append((size, len(b), min(at, default=None), max(at, default=None), ",".join(sorted(own)), ",".join(sorted(own | {s[0] for s in spans})), max([1.0] * bool(b) + [min(1.0, s[3]) for s in spans], default=0.0), [dict(zip(("label", "first", "last", "cover"), s, strict=True)) for s in spans]))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), _SPANS)
        return [pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)]


def license_scan(docs: DataFrame, scanner: Scanner | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    Whole texts are scanned in one pass without a shuffle; null or empty text has no words, no labels and score 0.
    score is 1 if a base phrase stands in the text, else the largest covered part of a wording that reaches min_cover.
    Repeated rows give repeated results; a null id stays null; other columns are ignored.
    """
    scanner = scanner or Scanner()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.record_batch([part.column("id"), *scanner.scan(part.column("text"))], names=["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, f"id long, {RESULT}").withColumnRenamed("id", id_col)
