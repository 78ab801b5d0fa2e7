"""Licence scans with a generalised suffix automaton of licence words.

Words are runs of ASCII letters, digits and non-ASCII characters, in ASCII lower case. The
automaton of all template texts answers, word by word, how long a suffix of what was read so
far occurs in some template (matching statistics), and where: a state knows all places of its
words. Every place that neither side extends and that has MIN_MATCH words is a match, in each
template that holds it. Matches that lie in order in both texts are chained per template, gaps of
up to GAP words allowed. A chain covering COVER of its template, or LEAST words of it, gives the
template's label and a covered span, unless a chain of another label covers more words around it;
labels that cover equally are all given.

Texts stream through in chunks: hashes decide in numpy which words, and which runs of MIN_MATCH of
them, occur in a template at all, and only such runs enter the automaton. Base labels are
plain phrases, found at every place.

Nulls and edges: a null or empty text has no words and score 0; very long texts are scanned
whole; repeated rows are each scanned alike; ties are told above; an empty table returns no rows;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import groupby
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from orrery.llm.shared import byte_class, hash_word, mix, span_hashes, text_chunks, word_spans

ALNUM = byte_class("alnum")
MIN_MATCH, GAP, COVER, LEAST = 4, 12, 0.6, 16

#: Phrases of the base labels: fixed values.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Notices and short texts of well-known public licences: label -> texts. Long texts lie in the folder LONG.
NOTICES = {
    "mit": [
        "Released under the MIT License",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "cc-by": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0"],
}
LONG = Path(__file__).with_name("licence_texts")


def default_templates() -> dict[str, list[str]]:
    """NOTICES and the whole texts of the folder LONG; a file is named label.txt or label-version.txt."""
    out = {label: list(texts) for label, texts in NOTICES.items()}
    for path in sorted(LONG.glob("*.txt")):
        out.setdefault(path.stem.partition("-")[0], []).append(path.read_text())
    return out


def words_of(text: str) -> list[str]:
    data = np.frombuffer(text.encode(), np.uint8)
    if not len(data):
        return []
    starts, ends, _ = word_spans(data, np.array([0, len(data)]), ALNUM)
    return ["".join(chr(c + 32) if 65 <= c <= 90 else chr(c) for c in data[a:b].tolist()) if max(data[a:b]) < 128 else data[a:b].tobytes().decode() for a, b in zip(starts, ends, strict=True)]


class SuffixAutomaton:
    """Of several word sequences; per state the longest length, the suffix link and where its words end."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        self.ends: list[list[tuple[int, int]]] = [[]]  # places whose whole prefix is the state's; others are its children's
        for number, words in enumerate(sequences):
            last = 0
            for at, word in enumerate(words):
                last = self._extend(last, word)
                self.ends[last].append((number, at))
        self.children: list[list[int]] = [[] for _ in self.size]
        for state, link in enumerate(self.link[1:], 1):
            self.children[link].append(state)
        self.known: dict[int, list[tuple[int, int]]] = {}

    def _state(self, size: int, link: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.size.append(size)
        self.link.append(link)
        self.ends.append([])
        return len(self.size) - 1

    def places(self, state: int) -> list[tuple[int, int]]:
        """(sequence, end) of all occurrences of a state's words."""
        if state not in self.known:
            out, todo = [], [state]
            while todo:
                one = todo.pop()
                out += self.ends[one]
                todo += self.children[one]
            self.known[state] = out
        return self.known[state]

    def _split(self, p: int, q: int, word: int) -> int:
        clone = self._state(self.size[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, word: int) -> int:
        q = self.next[last].get(word)
        if q is not None:
            return q if self.size[q] == self.size[last] + 1 else self._split(last, q, word)
        new = self._state(self.size[last] + 1, 0, {})
        p = last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[new] = q if self.size[q] == self.size[p] + 1 else self._split(p, q, word)
        return new

    def statistics(self, words: list[int]):
        """(length, state) after each word: the longest suffix read that occurs in a sequence."""
        state, size = 0, 0
        for word in words:
            while state and word not in self.next[state]:
                state = self.link[state]
                size = self.size[state]
            if word in self.next[state]:
                state = self.next[state][word]
                size += 1
            yield size, state


class LicenseScanner:
    def __init__(self, templates: dict[str, list[str]] | None = None, phrases: dict[str, str] | None = None):
        templates, self.phrases = templates or default_templates(), phrases if phrases is not None else PHRASES
        texts = [(label, words_of(t)) for label, ts in templates.items() for t in ts]
        vocabulary = sorted({w for _, ws in texts for w in ws} | {w for p in self.phrases for w in p.split()})
        hashes = np.array([hash_word(w) for w in vocabulary], dtype=np.uint64)
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        number = {vocabulary[k]: n + 1 for n, k in enumerate(order)}
        slot = (self.hashes >> np.uint64(48)).astype(np.int64)  # a first look that most words fail
        self.maybe = np.zeros(1 << 16, dtype=bool)
        self.maybe[slot] = True
        self.labels = [label for label, _ in texts]
        self.sequences = [[number[w] for w in ws] for _, ws in texts]
        self.automaton = SuffixAutomaton(self.sequences)
        self.base = [([number[w] for w in p.split()], label) for p, label in self.phrases.items()]
        self.grams = np.unique(np.concatenate([np.zeros(0, np.uint64), *(self._grams(np.array(s, np.int64)) for s in self.sequences)]))

    @staticmethod
    def _grams(numbers: np.ndarray) -> np.ndarray:
        """Hashes of MIN_MATCH words from each place on."""
        n = max(len(numbers) - MIN_MATCH + 1, 0)
        out = np.zeros(n, np.uint64)
        for k in range(MIN_MATCH):
            out = mix(out + numbers[k : k + n].astype(np.uint64))
        return out

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Vocabulary numbers of words; 0 for all others."""
        out = np.zeros(len(hashes), dtype=np.int32)
        near = np.flatnonzero(self.maybe[(hashes >> np.uint64(48)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.hashes, hashes[near]), len(self.hashes) - 1)
        out[near] = np.where(self.hashes[at] == hashes[near], at + 1, 0)
        return out

    def matches(self, words: list[int]) -> list[tuple[int, int, int, int]]:
        """(start, template, template start, length) of all matches that neither side extends; none may be extended past `words`."""
        out, auto = [], self.automaton
        for at, (size, state) in enumerate(auto.statistics(words)):
            after, child = words[at + 1] if at + 1 < len(words) else 0, -1
            while size >= MIN_MATCH:
                # places of the state that its longer suffix hasn't: there the words before differ
                here = [*auto.ends[state], *(p for c in auto.children[state] if c != child for p in auto.places(c))] if child >= 0 else auto.places(state)
                for template, end in here:
                    whole = self.sequences[template]
                    if end + 1 == len(whole) or whole[end + 1] != after:
                        out.append((at - size + 1, template, end - size + 1, size))
                child, state = state, auto.link[state]
                size = auto.size[state]
        return out

    def spans(self, found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, str]]:
        """(first word, last word + 1, label) of chains that cover enough of a template."""
        chains: list[list] = []  # template, start, end in text, end in template, covered
        open_: dict[int, list[list]] = {}
        for start, template, place, size in sorted(found):
            near = open_[template] = [c for c in open_.get(template, ()) if start - c[2] <= GAP]
            fits = [c for c in near if -size < start - c[2] and -size < place - c[3] <= GAP]
            if fits:
                chain = max(fits, key=lambda c: c[4])
                skip = max(0, chain[2] - start, chain[3] - place)
                chain[2:] = [max(chain[2], start + size), place + size, chain[4] + size - skip]
            else:
                chains.append([template, start, start + size, place + size, size])
                near.append(chains[-1])
        enough = {(c[1], c[2], self.labels[c[0]], c[4]) for c in chains if c[4] >= min(LEAST, COVER * len(self.sequences[c[0]]))}

        return sorted((c[0], c[1], c[2]) for c in outermost(enough))

    def scan(self, data: np.ndarray, offsets: np.ndarray):
        """Per row: words, base places (start, label), spans (start, end, label)."""
        starts, ends, counts = word_spans(data, offsets, ALNUM)
        numbers = self.numbers(span_hashes(data)(starts, ends)) if len(data) else np.zeros(0, np.int32)
        first = np.concatenate(([0], np.cumsum(counts)))
        row = np.repeat(np.arange(len(counts)), counts)
        base: dict[int, list] = {}
        for phrase, label in self.base:
            at = np.flatnonzero(numbers == phrase[0])
            for k, word in enumerate(phrase[1:], 1):
                at = at[at + k < len(numbers)]
                at = at[(numbers[at + k] == word) & (row[at + k] == row[at])]
            for a in at.tolist():
                base.setdefault(int(row[a]), []).append((a - int(first[row[a]]), label))
        chained: dict[int, list] = {}
        if len(numbers) >= MIN_MATCH and len(self.grams):
            n = len(numbers) - MIN_MATCH + 1
            inside = numbers != 0
            maybe = np.flatnonzero(inside[:n] & inside[1 : n + 1] & inside[MIN_MATCH - 1 :] & (row[:n] == row[MIN_MATCH - 1 :]))
            grams = np.zeros(len(maybe), np.uint64)
            for k in range(MIN_MATCH):
                grams = mix(grams + numbers[maybe + k].astype(np.uint64))
            held = self.grams[np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)] == grams
            at = maybe[held]
            new = np.flatnonzero(np.concatenate(([True], np.diff(at) != 1)) | np.concatenate(([True], row[at[1:]] != row[at[:-1]]))) if len(at) else np.zeros(0, np.int64)
            found: dict[int, list] = {}
            for a, b in zip(at[new].tolist(), at[np.append(new[1:], len(at)) - 1].tolist() if len(at) else [], strict=True):
                r = int(row[a])
                found.setdefault(r, []).extend((m[0] + a - int(first[r]), *m[1:]) for m in self.matches(numbers[a : b + MIN_MATCH].tolist()))
            chained = {r: s for r, f in found.items() if (s := self.spans(f))}
        return counts, base, chained


def outermost(chains: set[tuple[int, int, str, int]]) -> list[tuple[int, int, str, int]]:
    """Chains (first, end, label, covered) without those that add nothing to another: a part of one that covers more, or as much of the same label.

    From the most covered down: a tree over the starts tells the furthest end of all chains so far that begin no later.
    """
    begins = sorted({c[0] for c in chains})
    tree = [0] * (len(begins) + 1)
    kept = []
    for _, equal in groupby(sorted(chains, key=lambda c: (-c[3], c[2], c[0], -c[1])), key=lambda c: c[3]):
        equal = list(equal)
        label, furthest = None, 0
        for c in equal:
            if c[2] != label:
                label, furthest = c[2], 0
            at, end = bisect_right(begins, c[0]), furthest
            while at:
                end, at = max(end, tree[at]), at & (at - 1)
            if end < c[1]:
                kept.append(c)
            furthest = max(furthest, c[1])
        for c in equal:
            at = bisect_right(begins, c[0])
            while at < len(tree):
                tree[at], at = max(tree[at], c[1]), at + (at & -at)
    return kept


def covered_words(spans: list[tuple[int, int, str]]) -> int:
    total, end = 0, 0
    for a, b, _ in sorted(spans):
        total += max(0, b - max(a, end))
        end = max(end, b)
    return total


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<first:long,last:long,label:string>>"


def scan_licenses(docs: DataFrame, templates: dict[str, list[str]] | None = None, phrases: dict[str, str] | None = None) -> DataFrame:
    """Per row of docs (doc_id, text): counts, labels, spans (words first to last, from 0) and score, the share of words in spans."""
    held = docs.sparkSession.sparkContext.broadcast(LicenseScanner(templates, phrases))  # as large as the templates

    def run(batches):
        scanner = held.value
        for batch in batches:
            for i, j, data, offsets in text_chunks(batch.column(0)):
                counts, base, chained = scanner.scan(data, offsets)
                rows = []
                for r in range(j - i):
                    places, spans = base.get(r, ()), chained.get(r, ())
                    at = [p for p, _ in places]
                    mine = {label for _, label in places}
                    rows.append((
                        int(counts[r]), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(mine)), ",".join(sorted(mine | {s[2] for s in spans})),
                        covered_words(list(spans)) / int(counts[r]) if spans else 0.0, [{"first": a, "last": b - 1, "label": label} for a, b, label in spans],
                    ))
                kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("label", pa.string())]))]
                columns = [pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(i, j - i), *columns], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    from pyspark.sql import functions as F

    return docs.select("text", F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(run, SCHEMA)
