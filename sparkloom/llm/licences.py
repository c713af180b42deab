"""License scans: matching statistics against a suffix automaton of licence texts, chained into covered spans (operator 11)."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, read_table
from .decontaminate import _FOLD, _Builder

# The phrases and labels of the contract.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Published licence texts and notices, without the names and years that each work fills in.
TEMPLATES = {
    "mit": ("""Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the
Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR
IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""", "SPDX-License-Identifier: MIT"),
    "bsd": ("""Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source
code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of
conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may
be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS
OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR
CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA,
OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""", "SPDX-License-Identifier: BSD-3-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    "isc": ("""Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this
permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION
OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""", "SPDX-License-Identifier: ISC"),
    "apache": ("""Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
        "Licensed under the Apache License, Version 2.0", "SPDX-License-Identifier: Apache-2.0"),
    "gpl": ("""This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either
version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program.
If not, see https://www.gnu.org/licenses/.""", "licensed under the GNU General Public License, version 3", "licensed under the GNU General Public License, version 2"),
    "lgpl": ("""This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation;
either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.""", "licensed under the GNU Lesser General Public License"),
    "mpl": ("""This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at
http://mozilla.org/MPL/2.0/.""", "SPDX-License-Identifier: MPL-2.0"),
    "unlicense": ("""This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in
source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",),
    "zlib": ("""This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin
of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be
appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered
from any source distribution.""",),
    "boost": ("""Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the
"Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to
do so, all subject to the following.""",),
    "cc-by": ("This work is licensed under a Creative Commons Attribution 4.0 International License", "licensed under CC BY 4.0"),
    "cc-by-sa": ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "licensed under CC BY-SA 4.0"),
    "cc-by-nc": ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "licensed under CC BY-NC 4.0"),
    "cc0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", "licensed under CC0 1.0"),
}

#: Words of the shortest match that takes part in a chain, words of a text between two matches of a chain, and the share of a template that its chain must cover.
LEAST_MATCH, MOST_GAP, COVERED = 4, 32, 0.75
#: The score of a text that names a licence by a phrase and gives none.
NAMED = 0.5
PIECE = 1 << 20

_NAMES = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")
_RESULT = ("n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
           "spans array<struct<label:string,template:int,first_word:long,end_word:long,covered:double>>")


def words_of(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, a stretch at a time."""
    text, at = text.translate(_FOLD), 0
    while at < len(text):
        end = text.find(b" ", at + PIECE)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


class LicenceAutomaton:
    """All word strings of the templates and phrases, and where each stands in the templates."""

    def __init__(self, templates: Mapping[str, tuple[str, ...]], phrases: Mapping[str, str], least: int = LEAST_MATCH):
        self.ids: dict[bytes, int] = {}
        grown = _Builder()
        numbered = lambda text: [self.ids.setdefault(w, len(self.ids)) for part in words_of(text.encode()) for w in part]
        self.templates = [(label, numbered(text)) for label, texts in templates.items() for text in texts]
        self.phrases = [(label, numbered(text)) for text, label in phrases.items()]
        self.least = min([least, *(len(w) for _, w in self.templates if w)])
        for _, word_ids in (*self.templates, *self.phrases):
            last = 0
            for c in word_ids:
                last = grown.extend(last, c)
        self.next, self.link, self.length = grown.next, grown.link, grown.length
        #: state: (template, end) of each place at which its strings end, for strings that can be matches.
        self.ends: dict[int, list[tuple[int, int]]] = {}
        for k, (_, word_ids) in enumerate(self.templates):
            s = 0
            for end, c in enumerate(word_ids, 1):
                s = up = self.next[s][c]
                while self.length[up] >= self.least:
                    self.ends.setdefault(up, []).append((k, end))
                    up = self.link[up]
        #: state: the phrases whose last word its strings end with, as (words, label).
        self.named: dict[int, list[tuple[int, str]]] = {}
        for label, word_ids in self.phrases:
            for s in range(1, len(self.next)):
                if self._ends_with(s, word_ids):
                    self.named.setdefault(s, []).append((len(word_ids), label))

    def _ends_with(self, s: int, word_ids: list[int]) -> bool:
        """Whether the longest string of s ends with these words: their own state lies up the links."""
        own = 0
        for c in word_ids:
            own = self.next[own][c]
        while s > 0 and s != own:
            s = self.link[s]
        return s == own > 0

    def scan(self, parts: Iterator[list[bytes]]) -> tuple[int, list[tuple[int, str]], list[tuple[int, int, int]]]:
        """(words, (start, label) of the phrases, (end, length, state) of the matches that no further word lengthens) of a text, in one pass."""
        get, follow, link, length, named, least = self.ids.get, self.next, self.link, self.length, self.named, self.least
        places: list[tuple[int, str]] = []
        matches: list[tuple[int, int, int]] = []
        s = n = at = 0
        for part in parts:
            for i, c in enumerate(map(get, part), at):
                if c is None:
                    if n >= least:
                        matches.append((i, n, s))
                    s = n = 0
                    continue
                t = follow[s].get(c)
                if t is None:
                    if n >= least:
                        matches.append((i, n, s))
                    while t is None:  # every word of a template leads on from the start
                        s = link[s]
                        n = length[s]
                        t = follow[s].get(c)
                s, n = t, n + 1
                if s in named:
                    places += [(i + 1 - size, label) for size, label in named[s] if size <= n]
            at += len(part)
        if n >= least:
            matches.append((at, n, s))
        return at, places, matches

    def chains(self, matches: list[tuple[int, int, int]], gap: int) -> list[tuple[int, int, int, int]]:
        """(template, first word, end, covered words) of the best chain from each match that begins one.

        Matches of a chain lie in the same order in text and template, at most `gap` words of text apart; words on which two overlap count once.
        """
        anchors: dict[int, list[tuple[int, int, int]]] = {}
        for end, n, s in matches:
            for k, there in self.ends[s]:
                anchors.setdefault(k, []).append((end, there, n))
        out = []
        for k, mine in anchors.items():
            mine.sort()
            reach = len(self.templates[k][1]) + gap
            best, begin, last = [], [], {}
            for i, (end, there, n) in enumerate(mine):
                covered, start = n, end - n
                for j in range(i - 1, -1, -1):
                    end_j, there_j, _ = mine[j]
                    if end - end_j > reach:
                        break
                    gain = min(n, end - end_j, there - there_j)
                    if gain > 0 and end - n - end_j <= gap and best[j] + gain > covered:
                        covered, start = best[j] + gain, begin[j]
                best.append(covered)
                begin.append(start)
                if covered > last.get(start, (0, 0))[0]:
                    last[start] = covered, end
            out += [(k, start, end, covered) for start, (covered, end) in last.items()]
        return out

    def spans(self, matches: list[tuple[int, int, int]], gap: int, share: float) -> list[tuple[str, int, int, int, float]]:
        """(label, template, first word, end, covered share) of chains that cover enough of their template; of those of one label that overlap, the best."""
        enough = [(covered / len(self.templates[k][1]), k, a, b) for k, a, b, covered in self.chains(matches, gap) if covered >= share * len(self.templates[k][1])]
        kept: dict[str, list[tuple[str, int, int, int, float]]] = {}
        for part, k, a, b in sorted(enough, key=lambda x: (-x[0] * len(self.templates[x[1]][1]), -x[0], x[2], x[1])):
            label = self.templates[k][0]
            mine = kept.setdefault(label, [])
            if all(b <= x[2] or x[3] <= a for x in mine):
                mine.append((label, k, a, b, part))
        return sorted((x for mine in kept.values() for x in mine), key=lambda x: (x[2], x[0], x[1]))


#: The automaton that this worker has built last, under the name of its templates.
_built: dict[str, LicenceAutomaton] = {}


def _scanner(name: str, held: Broadcast, gap: int, share: float):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _built:
            _built.clear()
            _built[name] = LicenceAutomaton(*held.value)
        automaton = _built[name]
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        span = pa.list_(pa.struct([("label", pa.string()), ("template", pa.int32()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("covered", pa.float64())]))
        for batch in pieces(batches):
            rows = []
            for text in batch.column(batch.num_columns - 1):
                n, places, matches = automaton.scan(words_of(text.as_py()))
                spans = automaton.spans(matches, gap, share)
                starts, base = [p for p, _ in places], {label for _, label in places}
                score = max([*(x[4] for x in spans), NAMED if base else 0.0])
                rows.append((n, len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | {x[0] for x in spans})), score, spans))
            rest = batch.drop_columns([batch.schema.names[-1]])
            found = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            found.append(pa.array([[dict(zip(("label", "template", "first_word", "end_word", "covered"), x)) for x in r[-1]] for r in rows], span))
            yield pa.RecordBatch.from_arrays([*rest.columns, *found], names=[*rest.schema.names, *_NAMES])

    return scan


def scan_licences(docs: DataFrame, templates: Mapping[str, tuple[str, ...]] = TEMPLATES, phrases: Mapping[str, str] = PHRASES,
                  gap: int = MOST_GAP, share: float = COVERED, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """Licences in every whole text of docs: the columns of keep, n_words, n_base, first_word, last_word, base_labels, labels, score and spans.

    Words are runs of ASCII letters and digits, A-Z as a-z, and of all that is not ASCII. The words are streamed once through the suffix automaton of all templates and
    phrases. Base: places where a phrase's words stand (n_base, the least and greatest start, their labels). Matches of at least LEAST_MATCH words that no further word lengthens are chained:
    in the order of text and template, at most `gap` words apart, so that names and years may stand between. A chain that covers the `share` of a template gives
    its label and a span (template is its number in `templates`, words from 0, the end not included). score is the largest covered share, at least NAMED where a phrase stands.

    Null and empty texts have no words, no labels ('') and score 0. Rows are judged by themselves, so repeated and null ids are rows like others; texts may be of any length. An empty table gives an empty
    result; columns that are not in keep are ignored. Nothing is shuffled; what is broadcast are the templates, an argument.
    """
    rows = docs.select(*keep, F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("_bytes"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    held = docs.sparkSession.sparkContext.broadcast((dict(templates), dict(phrases)))
    return rows.mapInArrow(_scanner(uuid.uuid4().hex, held, gap, share), f"{schema}, {_RESULT}" if keep else _RESULT)


def op11_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(read_table(spark, sf_dir, "documents")).drop("spans")
