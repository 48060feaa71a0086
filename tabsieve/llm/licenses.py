"""License scans by template markup.

Templates are plain wording with two kinds of marked region: <<optional>> ... <<end>> may be absent as a whole, and
<<var N>> stands for up to N tokens of any wording.  Templates are compiled into token automata, which accept a text
only if all mandatory wording matches token by token.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass, field
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import ALNUM_OR_HIGH, LOWER

# Phrases that name a license, and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Wording of well-known licenses and of the notices that name longer ones, marked up.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software
    <<optional>>and associated documentation files<<end>> (the "Software"), to deal in the Software without
    restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute,
    sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do
    so, subject to the following conditions: The above copyright notice and this permission notice
    <<optional>>(including the next paragraph)<<end>> shall be included in all copies or substantial portions of
    the Software."""
_ISC = """Permission to use, copy, modify, and<<optional>>/or<<end>> distribute this software for any purpose with or
    without fee is hereby granted, provided that the above copyright notice and this permission notice appear in
    all copies."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided
    that the following conditions are met: <<optional>>1<<end>> Redistributions of source code must retain the
    above copyright notice, this list of conditions and the following disclaimer. <<optional>>2<<end>>
    Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
    following disclaimer in the documentation and/or other materials provided with the distribution."""
TEMPLATES = {
    "mit-permission": _MIT,
    "mit-text": _MIT
    + """ THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED
        TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL
        <<var 20>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
        OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
        SOFTWARE.""",
    "isc-permission": _ISC,
    "isc-text": _ISC
    + """ THE SOFTWARE IS PROVIDED "AS IS" AND <<var 20>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING
        ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<var 20>> BE LIABLE FOR ANY SPECIAL,
        DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR
        PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN
        CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "bsd-conditions": _BSD,
    "bsd-text": _BSD
    + """ <<optional>>3<<end>> <<optional>>Neither the name of <<var 20>> nor the names of its contributors may be used to
        endorse or promote products derived from this software without specific prior written permission.<<end>> THIS
        SOFTWARE IS PROVIDED BY <<var 20>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED
        TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT
        SHALL <<var 20>> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
        (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR
        BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
        OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF
        ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "zlib-text": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors
        be held liable for any damages arising from the use of this software. Permission is granted to anyone to use
        this software for any purpose, including commercial applications, and to alter it and redistribute it freely,
        subject to the following restrictions: <<optional>>1.<<end>> The origin of this software must not be
        misrepresented; you must not claim that you wrote the original software. If you use this software in a
        product, an acknowledgment in the product documentation would be appreciated but is not required.
        <<optional>>2.<<end>> Altered source versions must be plainly marked as such, and must not be misrepresented
        as being the original software. <<optional>>3.<<end>> This notice may not be removed or altered from any
        source distribution.""",
    "apache-notice": """Licensed under the Apache License, Version 2.0 <<optional>>(the "License"); you may not use this
        file except in compliance with the License. You may obtain a copy of the License at
        <<var 8>> Unless required by applicable law or agreed to in writing, software distributed under the License is
        distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.<<end>>""",
    "gpl-notice": """<<var 6>> is free software<<optional>>: you can redistribute it and/or modify it<<end>> under the terms of
        the GNU <<optional>>Lesser<<end>> <<optional>>Affero<<end>> General Public License as published by the Free
        Software Foundation, either version <<var 2>> of the License, or <<optional>>(at your option)<<end>> any later
        version.""",
    "mpl-notice": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL
        was not distributed with this file, You can obtain one at <<var 6>>""",
    "mit-notice": """<<optional>>This software is<<end>> Released under the MIT License""",
}

_KEEP = bytes(LOWER[i] if ALNUM_OR_HIGH[LOWER[i]] else 0x20 for i in range(256))
_PHRASE = re.compile(rb"(?<![^ ])(?:" + b"|".join(p.encode() for p in PHRASES) + rb")(?![^ ])")


def words_of_text(text: bytes) -> list[bytes]:
    """A-Z lower-cased; words are runs of digits, letters and non-ASCII bytes."""
    return text.translate(_KEEP).split()


@dataclass
class Automaton:
    """A token automaton: edges by token, edges for any token, and moves without a token."""

    name: str
    token: list[dict[bytes, int]] = field(default_factory=lambda: [{}])
    any: dict[int, int] = field(default_factory=dict)
    free: dict[int, list[int]] = field(default_factory=dict)
    final: int = 0
    mandatory: int = 0

    def state(self) -> int:
        self.token.append({})
        return len(self.token) - 1

    def closure(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for t in self.free.get(todo.pop(), ()):
                if t not in states:
                    states.add(t)
                    todo.append(t)
        return states

    def accepts(self, words: list[bytes], start: int) -> int | None:
        """End of the longest match that begins at a word, or None."""
        now, end = self.closure({0}), None
        i = start
        while now:
            if self.final in now:
                end = i
            if i == len(words):
                break
            w = words[i]
            now = self.closure({t for s in now if (t := self.token[s].get(w)) is not None} | {self.any[s] for s in now if s in self.any})
            i += 1
        return end


def compile_template(name: str, markup: str) -> tuple[Automaton, bytes]:
    """The automaton of a template, from its first mandatory wording on, and that wording up to the next mark."""
    parts = [p for p in re.split(r"(<<.*?>>)", markup) if p.strip()]
    depth = 0
    while parts and (parts[0].startswith("<<") or depth):  # what may precede the mandatory wording
        depth += {"<<optional>>": 1, "<<end>>": -1}.get(parts[0], 0)
        parts.pop(0)
    if not parts:
        raise ValueError(f"template {name} has no mandatory wording")
    a, at, opened = Automaton(name), 0, []
    for p in parts:
        if p == "<<optional>>":
            opened.append(at)
        elif p == "<<end>>":
            if not opened:
                raise ValueError(f"template {name}: <<end>> without <<optional>>")
            a.free.setdefault(opened.pop(), []).append(at)
        elif p.startswith("<<var"):
            first, after = at, a.state()
            a.free.setdefault(first, []).append(after)
            for _ in range(int(p[5:-2])):
                nxt = a.state()
                a.any[at] = nxt
                a.free.setdefault(nxt, []).append(after)
                at = nxt
            at = after
        else:
            for w in words_of_text(p.encode()):
                nxt = a.state()
                a.token[at][w] = nxt
                at = nxt
                a.mandatory += not opened
            # the next region gets a state of its own
            nxt = a.state()
            a.free.setdefault(at, []).append(nxt)
            at = nxt
    if opened:
        raise ValueError(f"template {name}: <<optional>> without <<end>>")
    a.final = at
    return a, b" ".join(words_of_text(parts[0].encode()))


def scan_text(text: bytes, automata: list[tuple[Automaton, bytes]]) -> tuple[int, list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Number of words; places of phrases, and of templates: (label, first word, word after last).

    Each place at which a template's first wording stands is tried for the length of the template at most, so that
    time grows with the text however often licenses repeat in it.
    """
    words = words_of_text(text)
    line = b" ".join(words)
    places: list[int] = []  # where words begin, made at the first hit

    def number(at: int) -> int:
        if not places:
            places.extend(accumulate((len(w) + 1 for w in words), initial=0))
        return bisect_left(places, at)

    base = []
    if b"license" in line:
        for m in _PHRASE.finditer(line):
            at = number(m.start())
            base.append((PHRASES[m[0].decode()], at, at + m[0].count(b" ") + 1))
    found = []
    for a, start in automata:
        at = line.find(start)
        while at >= 0:
            if (at == 0 or line[at - 1] == 0x20) and line[at + len(start) : at + len(start) + 1] in (b"", b" "):
                first = number(at)
                end = a.accepts(words, first)
                if end is not None:
                    found.append((a.name, first, end))
            at = line.find(start, at + 1)
    return len(words), base, found


SHAPE = "doc_id long, n_words long, base array<struct<label:string,first:long,end:long>>, matches array<struct<label:string,first:long,end:long>>"


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None) -> DataFrame:
    """One row per document: doc_id, n_words, base and matches [(label, first word, word after last)].

    base holds all places of the naming phrases, matches those of accepted templates; null texts are empty.  Every
    whole text is scanned; rows are independent of one another, so null and repeated ids are kept as they are.  An
    empty table gives no rows.
    """
    automata = [compile_template(k, v) for k, v in (TEMPLATES if templates is None else templates).items()]
    spans = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64())]))

    def scan(batches):
        for b in batches:
            got = [scan_text(t.as_buffer().to_pybytes() if t.is_valid else b"", automata) for t in b.column(1)]
            listed = lambda k: pa.array([[{"label": x, "first": y, "end": z} for x, y, z in g[k]] for g in got], spans)  # noqa: B023, E731
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "n_words": pa.array([g[0] for g in got], pa.int64()), "base": listed(1), "matches": listed(2)})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(scan, SHAPE)


def op3_license_scan(spark, sf_dir: str) -> DataFrame:
    """Labels of all documents; score: 1 with an accepted template, 0.5 with a naming phrase alone, else 0."""
    found = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    first = F.transform("base", lambda x: x["first"])
    names = lambda *c: F.array_join(F.array_sort(F.array_distinct(F.concat(*[F.transform(k, lambda x: x["label"]) for k in c]))), ",")
    score = F.when(F.size("matches") > 0, 1.0).when(F.size("base") > 0, 0.5).otherwise(0.0)
    return found.select("doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(first).alias("first_word"), F.array_max(first).alias("last_word"), names("base").alias("base_labels"), names("base", "matches").alias("labels"), score.alias("score"))
