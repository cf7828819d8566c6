"""License scans by template-markup matching.

A template is a license's whole text with markup: [[words]] may be missing, {{n}} stands for one to n words
of any kind, {{0-n}} for none to n.  It is compiled into an automaton over words; a place in a text
is accepted when the words from there on lead the automaton to its end, so all wording outside the
markup must agree exactly, while case, punctuation and line breaks don't count.  Sentences that refer
to a license are templates of their own, with a lower score.  Beside them, fixed phrases are counted
wherever their words stand consecutively.

Words are runs of ASCII letters, digits and characters outside ASCII, with A-Z lower-cased.

Scale: a map over rows without a shuffle.  A text is only walked where the first wording of a
template stands; the automaton holds a set of states, no words, so memory goes with the text alone.

Defined cases: a null text counts as empty (no words, no labels, score 0); repeated rows give
repeated results; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, documents
from .hashing import text_buffer

#: Fixed phrases and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Sentences by which files refer to a license, and the whole wording of public licenses
# and of the notices that licenses ask for, with the markup of this module where their forms differ.
NOTICES = (
    ("mit-notice", "released under the [[terms of the]] MIT license"),
    ("mit-notice", "licensed under the [[terms of the]] MIT license"),
    ("apache-notice", "licensed under the Apache license [[version 2.0]]"),
    ("gpl-notice", "under the terms of the [[GNU]] general public license"),
    ("gpl-notice", "distributed under the [[GNU]] general public license"),
)
TEMPLATES = (
    (
        "mit-text",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
        associated documentation files (the "Software"), to deal in the Software without restriction, including
        without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
        copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
        following conditions: The above copyright notice and this permission notice [[(including the next
        paragraph)]] shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS
        PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
        WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL
        {{1-20}} BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
        OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
        SOFTWARE.""",
    ),
    (
        "isc-text",
        """Permission to use, copy, modify, and[[/or]] distribute this software for any purpose with or without
        fee is hereby granted, provided that the above copyright notice and this permission notice appear in all
        copies. THE SOFTWARE IS PROVIDED "AS IS" AND {{1-20}} DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS
        SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL {{1-20}} BE
        LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING
        FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION,
        ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
    (
        "bsd-text",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided
        that the following conditions are met: [[1]] Redistributions of source code must retain the above copyright
        notice, this list of conditions and the following disclaimer. [[2]] Redistributions in binary form must
        reproduce the above copyright notice, this list of conditions and the following disclaimer in the
        documentation and/or other materials provided with the distribution. [[ [[3]] Neither the name of {{1-20}}
        nor the names of {{1-4}} contributors may be used to endorse or promote products derived from this software
        without specific prior written permission. ]] THIS SOFTWARE IS PROVIDED BY {{1-20}} "AS IS" AND ANY EXPRESS
        OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS
        FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL {{1-20}} BE LIABLE FOR ANY DIRECT, INDIRECT,
        INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF
        SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON
        ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE)
        ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    ),
    (
        "apache-text",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at {{1-12}} Unless required by applicable
        law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
        WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
        language governing permissions and limitations under the License.""",
    ),
    (
        "gpl-text",
        """is free softwareyou can redistribute it and/or modify it under the terms of the GNU [[Lesser]]
        [[Library]] [[Affero]] General Public License as published by the Free Software Foundation, either
        version {{1-3}} of the License, or (at your option) any later version. {{1-4}} is distributed in the hope
        that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or
        FITNESS FOR A PARTICULAR PURPOSE. See the GNU [[Lesser]] [[Library]] [[Affero]] General Public License for
        more details. You should have received a copy of the GNU [[Lesser]] [[Library]] [[Affero]] General Public
        License along with {{1-20}}""",
    ),
    (
        "zlib-text",
        """This software is provided 'as-is', without any express or implied warranty. In no event will {{1-20}} be
        held liable for any damages arising from the use of this software. Permission is granted to anyone to use
        this software for any purpose, including commercial applications, and to alter it and redistribute it
        freely, subject to the following restrictions: [[1]] The origin of this software must not be misrepresented;
        you must not claim that you wrote the original software. If you use this software in a product, an
        acknowledgment in the product documentation would be appreciated but is not required. [[2]] Altered source
        versions must be plainly marked as such, and must not be misrepresented as being the original software.
        [[3]] This notice may not be removed or altered from any source distribution.""",
    ),
    (
        "boost-text",
        """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software
        and accompanying documentation covered by this license (the "Software") to use, reproduce, display,
        distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit
        third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices
        in the Software and this entire statement, including the above license grant, this restriction and the
        following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative
        works of the Software, unless such copies or derivative works are solely in the form of machine-executable
        object code generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY
        KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A
        PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING
        THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING
        FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    (
        "unlicense-text",
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
        publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary,
        for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright
        laws, the author or authors of this software dedicate any and all copyright interest in the software to the
        public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs
        and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and
        future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY
        KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A
        PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
        LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
        SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
)

_WORD = rb"[0-9a-z\x80-\xff]+"
_GAP = rb"[^0-9a-z\x80-\xff]+"
_EDGE, _END = rb"(?<![0-9a-z\x80-\xff])", rb"(?![0-9a-z\x80-\xff])"


class Template:
    """A token automaton: steps[s] lists (word or None for any, next state), skips[s] the states
    that are reached from s without a word."""

    def __init__(self, label: str, text: str):
        self.label = label
        self.steps: list[list[tuple[bytes | None, int]]] = [[]]
        self.skips: list[list[int]] = [[]]
        opened: list[int] = []
        lead: list[bytes] = []
        plain = True
        at = 0
        for part in re.findall(r"\[\[|\]\]|\{\{(?:\d+-)?\d+\}\}|[0-9a-z\x80-\U0010ffff]+", text.lower()):
            if part == "[[":
                opened.append(at)
                plain = plain and not lead
            elif part == "]]":
                self.skips[opened.pop()].append(at)
            elif part.startswith("{{"):
                low, _, high = part[2:-2].rpartition("-")
                for k in range(int(high)):
                    if k >= (int(low) if low else 1):
                        self.skips[at].append(at + int(high) - k)
                    at = self._step(at, None)
                plain = False
            else:
                word = part.encode()
                at = self._step(at, word)
                if plain and not opened and len(lead) < 3:
                    lead.append(word)
            if opened or part == "]]":
                plain = False
        if opened or not lead:
            raise ValueError(f"a template needs closed markup and must begin with a mandatory word: {text[:60]}")
        self.end = at
        self.lead = re.compile(_EDGE + _GAP.join(lead) + _END)

    def _step(self, at: int, word: bytes | None) -> int:
        self.steps.append([])
        self.skips.append([])
        self.steps[at].append((word, len(self.steps) - 1))
        return len(self.steps) - 1

    def _close(self, states: set[int]) -> set[int]:
        todo, found = list(states), set(states)
        while todo:
            for s in self.skips[todo.pop()]:
                if s not in found:
                    found.add(s)
                    todo.append(s)
        return found

    def accepts(self, words: Iterator[bytes]) -> bool:
        """Whether some first words of `words` are the template's."""
        states = self._close({0})
        for word in words:
            states = self._close({to for s in states for need, to in self.steps[s] if need is None or need == word})
            if self.end in states:
                return True
            if not states:
                return False
        return self.end in states

    def found_in(self, lower: bytes) -> bool:
        return any(self.accepts(m[0] for m in re.finditer(_WORD, _tail(lower, hit.start()))) for hit in self.lead.finditer(lower))


def _tail(lower: bytes, start: int) -> memoryview:
    return memoryview(lower)[start:]


_COMPILED: dict[tuple, tuple] = {}


def _compiled(phrases: tuple, notices: tuple, templates: tuple) -> tuple:
    key = (phrases, notices, templates)
    if key not in _COMPILED:
        base = [(label, re.compile(_EDGE + _GAP.join(w.encode() for w in phrase.split()) + _END)) for phrase, label in phrases]
        made = [Template(label, text) for label, text in templates]
        _COMPILED[key] = (base, [Template(label, text) for label, text in notices], made)
    return _COMPILED[key]


_BODY = np.zeros(256, bool)
_BODY[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan_text(body: bytes, starts: np.ndarray, phrases: tuple = PHRASES, notices: tuple = NOTICES, templates: tuple = TEMPLATES) -> tuple:
    """(n_base, first_word, last_word, base_labels, labels, score) of one text; starts: where its words start."""
    base, said, made = _compiled(phrases, notices, templates)
    lower = body.lower()
    places, named = [], set()
    for label, pattern in base:
        hits = [m.start() for m in pattern.finditer(lower)]
        if hits:
            named.add(label)
            places += hits
    whole = {t.label for t in made if t.found_in(lower)}
    own = whole | {t.label for t in said if t.found_in(lower)}
    at = np.searchsorted(starts, np.array(places, np.int64)) if places else None
    return (
        len(places),
        None if at is None else int(at.min()),
        None if at is None else int(at.max()),
        ",".join(sorted(named)),
        ",".join(sorted(named | own)),
        1.0 if whole else 0.75 if own else 0.5 if named else 0.0,
    )


def scan_licenses(docs: DataFrame, phrases: tuple = PHRASES, notices: tuple = NOTICES, templates: tuple = TEMPLATES) -> DataFrame:
    """A row a document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    score: 1 where a license's whole mandatory wording is found, 0.75 where a sentence that refers to one
    is, 0.5 where only a phrase is, else 0.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, offsets = text_buffer(batch.column(1))
            rows = []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                solid = _BODY[values[a:b]]
                solid[1:] &= ~solid[:-1].copy()
                starts = np.flatnonzero(solid)
                rows.append((len(starts), *scan_text(values[a:b].tobytes(), starts, phrases, notices, templates)))
            cols = list(zip(*rows)) if rows else [()] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds))], [x.split()[0] for x in _SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _SCHEMA)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir))
