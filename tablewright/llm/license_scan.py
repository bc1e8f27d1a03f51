"""Licence notices in documents by conditional compression.

Words of licence language seed candidate blocks: a block reaches as many words to
both sides of them as a notice can have, so a notice is in it whole, however its
lines are broken or prefixed.  Each block is compressed by zstandard alone and
with each template as its raw dictionary; the bytes that a template saves rank the
templates.  They are held against the block by their wording in that order, and
the first that is confirmed wins: where almost all of its words stand in their
order, none that carries a number or tells it from a template of similar words is
missing, and no such word of another licence stands between them.  Templates behind
the winner are not tried on these words; the rest of the block is compressed and
judged again, so none is lost.  What is left with a word of licence language is a
row that is not confirmed, with the template that saves most.

A ``SPDX-License-Identifier`` tag is a block for each identifier of its expression
(exceptions after ``WITH`` aside), confirmed by the whole identifier; ``-only``,
``-or-later`` and ``+`` do not change the licence that is named.

``saving`` is the part of the most a template could save (compressing itself) that
it saves on the words it was confirmed for, or else on the block.

``block_line`` is the line where a confirmed notice begins, or else the line of
the first word of licence language.  A run of blocks of more than 2**20 words is judged
in parts that overlap by a notice's length, so memory does not grow with the text; a
rest without a confirmed notice is then a row in each part.

Null and empty texts have no blocks.  Rows are scanned each, also repeated ones;
a null ``doc_id`` stays null.  An empty table gives an empty result.  Equal
savings go to the template that comes first in the list.  Other columns are not
read.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark.sql import DataFrame

from .shared import text_slices

_MIT_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
_MIT_KEPT = ", subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_MIT_AS_IS = " THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_BSD_ADVERTISING = "All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the copyright holder. "
_BSD_NEITHER = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_AUTHOR = "The name of the author may not be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_AS_IS = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_KEPT = ", provided that the above copyright notice and this permission notice appear in all copies"
_ISC_AS_IS = ". THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
#: Usual wordings of licence notices, whole where an opening would not tell licences apart.
_NOTICES = [
    ("MIT", _MIT_GRANT + _MIT_KEPT + _MIT_AS_IS),
    ("MIT-0", _MIT_GRANT + "." + _MIT_AS_IS),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", _GNU.format("General Public License", "2")),
    ("GPL-3.0", _GNU.format("General Public License", "3")),
    ("LGPL-2.0", _GNU.format("Library General Public License", "2")),
    ("LGPL-2.1", _GNU.format("Lesser General Public License", "2.1")),
    ("LGPL-3.0", _GNU.format("Lesser General Public License", "3")),
    ("AGPL-3.0", _GNU.format("Affero General Public License", "3")),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-2-Clause", _BSD + _BSD_AS_IS),
    ("BSD-3-Clause", _BSD + _BSD_NEITHER + _BSD_AS_IS),
    ("BSD-3-Clause", _BSD + _BSD_AUTHOR + _BSD_AS_IS),
    ("BSD-4-Clause", _BSD + _BSD_ADVERTISING + _BSD_NEITHER + _BSD_AS_IS),
    ("ISC", _ISC + _ISC_KEPT + _ISC_AS_IS),
    ("0BSD", _ISC + _ISC_AS_IS),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
]
#: Names by which short notices call licences, and the notices' usual openings.
_CALLED = [
    ("MIT", "MIT License"),
    ("Apache-2.0", "Apache License, Version 2.0"),
    ("Apache-2.0", "Apache License 2.0"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("ISC", "ISC License"),
    ("MPL-2.0", "Mozilla Public License, version 2.0"),
    ("MPL-2.0", "Mozilla Public License 2.0"),
    ("GPL-2.0", "GNU General Public License, version 2"),
    ("GPL-2.0", "GNU General Public License v2.0"),
    ("GPL-3.0", "GNU General Public License, version 3"),
    ("GPL-3.0", "GNU General Public License v3.0"),
    ("LGPL-2.1", "GNU Lesser General Public License, version 2.1"),
    ("LGPL-3.0", "GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "GNU Affero General Public License, version 3"),
    ("BSL-1.0", "Boost Software License, Version 1.0"),
]
_OPENINGS = ["Released under the {}.", "Distributed under the {}.", "Licensed under the {}.", "under the terms of the {}."]
#: Short and long names of Creative Commons licences, and identifiers of the SPDX list.
_COMMONS = [("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives")]
_IDENTIFIERS = ["MIT", "MIT-0", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "MPL-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "ISC", "0BSD", "BSL-1.0", "Unlicense", *[f"CC-{short}-4.0" for short, _ in _COMMONS], "CC0-1.0"]
TAG = "SPDX-License-Identifier: "
TEMPLATES = [
    *_NOTICES,
    *[(name, opening.format(called)) for name, called in _CALLED for opening in _OPENINGS],
    *[(name, called + " or later") for name, called in _CALLED if called.startswith("GNU") and "version" in called],
    *[(f"CC-{short}-4.0", f"Licensed under CC {short} 4.0.") for short, _ in _COMMONS],
    *[(f"CC-{short}-4.0", f"Licensed under a Creative Commons {long} 4.0 International License.") for short, long in _COMMONS],
    *[(name, TAG + name) for name in _IDENTIFIERS],
]
CUES = r"(?i)licen[cs]|copyright|permission|redistribut|public\W+domain|creative\W+commons|spdx"
SCHEMA = "doc_id long, block_line long, license string, saving double, n_missing long, n_extra long, confirmed boolean"
_ARROW = pa.schema([("doc_id", pa.int64()), ("block_line", pa.int64()), ("license", pa.string()), ("saving", pa.float64()), ("n_missing", pa.int64()), ("n_extra", pa.int64()), ("confirmed", pa.bool_())])
_WORD = regex.compile(r"[\p{L}\p{N}]+(?:\.\p{N}+)*")
#: Names that in a long notice rule out other licences.
_NAMES = {"mit", "apache", "gnu", "lesser", "affero", "mozilla", "cc", "cc0"}
#: A tag with its expression, and what an identifier may add to the licence.
_TAG = regex.compile(r"(?i)\bSPDX-License-Identifier:[ \t]*((?:\([ \t]*)*[\w.+-]+(?:[ \t]*\))*(?:[ \t]+(?:AND|OR|WITH)[ \t]+(?:\([ \t]*)*[\w.+-]+(?:[ \t]*\))*)*)")
_LATER = regex.compile(r"(?i)(-only|-or-later|\+)$")
#: The number of a list's item.
_ITEM = regex.compile(r"\p{N}{1,2}[.)](?=\s|$)")
#: Templates of different licences with this share of their words in common are rivals; shorter ones than these words only name a licence.
RIVAL, SHORT = 0.6, 20
#: Shares of a template's words that may be missing, and that may stand between them.
MOST_MISSING, MOST_EXTRA = 0.1, 0.2
#: In an alignment, what a missing word costs, and a word that rules the template out; bits of a place.
_MISSING, _RULED_OUT, _PLACE = 2, 1 << 13, 25
#: Most words of a block that are judged together.
LONGEST = 1 << 20


def wording(text: str) -> list[str]:
    return _WORD.findall(text.lower())


@dataclass
class Match:
    license: str
    saving: float
    n_missing: int
    n_extra: int
    confirmed: bool
    begin: int = 0  # word
    end: int = 0
    line: int = 0


class Text:
    """Words of a text, their places, and the words of licence language."""

    def __init__(self, text: str, cue: regex.Pattern, number: dict[str, int]):
        found = list(_WORD.finditer(text))
        self.text, self.begin, self.end = text, [m.start() for m in found], [m.end() for m in found]
        self.words = [m.group().lower() for m in found]
        self.ids = np.fromiter((number.get(w, -1) for w in self.words), np.int64, len(found))
        self.item = np.fromiter((w.isdigit() and _ITEM.match(text, at) is not None for w, at in zip(self.words, self.begin)), bool, len(found))
        # Tags, and where they lie among the words.
        self.tags = [(bisect_left(self.end, m.start() + 1), bisect_left(self.begin, m.end()), m.group(1)) for m in _TAG.finditer(text)]
        # A cue is at the word in which it ends or begins; those of tags are dealt with.
        tagged = {at for a, b, _ in self.tags for at in range(a, b)}
        self.cues = sorted({min(bisect_left(self.end, m.start() + 1), len(found) - 1) for m in cue.finditer(text)} - tagged) if found else []

    def between(self, a: int, b: int) -> str:
        return self.text[self.begin[a] : self.end[b - 1]]

    def line(self, at: int) -> int:
        return self.text.count("\n", 0, self.begin[at])

    def cue_in(self, a: int, b: int) -> int | None:
        at = bisect_left(self.cues, a)
        return self.cues[at] if at < len(self.cues) and self.cues[at] < b else None

    def blocks(self, reach: int) -> list[tuple[int, int]]:
        """Runs of words within ``reach`` of a cue, between tags."""
        found: list[list[int]] = []
        starts, ends = [0, *(b for _, b, _ in self.tags)], [*(a for a, _, _ in self.tags), len(self.words)]
        for at in self.cues:
            part = bisect_right(starts, at) - 1
            a, b = max(at - reach, starts[part]), min(at + reach + 1, ends[part])
            if found and a <= found[-1][1] and found[-1][0] >= starts[part]:
                found[-1][1] = b
            else:
                found.append([a, b])
        return [(a, b) for a, b in found]


class Scanner:
    """The templates' compressors; made once by each task."""

    def __init__(self, templates: list[tuple[str, str]] = TEMPLATES, level: int = 3):
        make = lambda **more: zstandard.ZstdCompressor(level=level, write_checksum=False, write_content_size=False, **more)
        self.names = [name for name, _ in templates]
        self.alone = make()
        self.given = [make(dict_data=zstandard.ZstdCompressionDict(text.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for _, text in templates]
        self.most = [self.size(text) - len(g.compress(text.encode())) for (_, text), g in zip(templates, self.given)]
        self.words = [wording(text) for _, text in templates]
        self.cue = regex.compile(CUES)
        self.number = {w: i for i, w in enumerate(sorted(set().union(*self.words)))}
        self.ids = [[self.number[w] for w in words] for words in self.words]
        self.counts = [Counter(ids) for ids in self.ids]
        sets = [set(words) for words in self.words]
        # Words of at most a third of the licences that are named in a few words.
        short = {name: set().union(*(s for n, s, words in zip(self.names, sets, self.words) if n == name and len(words) < SHORT)) for name in self.names}
        common = set.intersection(*sets) if sets else set()
        named = {w for s in short.values() for w in s - common if sum(w in u for u in short.values()) * 3 <= len(short)}
        #: What each word of a template costs where it is missing, and what each known word costs where it stands between.
        self.costs, self.between = [], []
        for name, words, own in zip(self.names, self.words, sets):
            rivals = [s for n, s in zip(self.names, sets) if n != name and len(s & own) >= RIVAL * max(len(s), len(own))]
            brief = named if len(words) < SHORT else set()
            telling = set().union(*(own - s for s in rivals)) | own & brief
            foreign = set().union(*(s - own for s in rivals)) | {w for w in (brief or _NAMES) if w not in own}
            self.costs.append([_MISSING + _RULED_OUT * (w in telling or any(c.isdigit() for c in w)) for w in words])
            cost = np.ones(len(self.number) + 1, np.int64)  # the last one is that of unknown words
            cost[[self.number[w] for w in foreign if w in self.number]] += _RULED_OUT
            self.between.append(cost)
        #: A confirmed notice has no word further from any other than this.
        self.reach = int(max(map(len, self.words), default=0) * (1 + MOST_EXTRA)) + 1

    def size(self, text: str) -> int:
        return len(self.alone.compress(text.encode()))

    def rank(self, block: str) -> list[tuple[int, int]]:
        """Bytes saved by each template and its number, most first; of equal savings the first template."""
        raw, plain = block.encode(), self.size(block)
        return sorted(((plain - len(g.compress(raw)), k) for k, g in enumerate(self.given)), key=lambda r: (-r[0], r[1]))

    def part(self, saved: int, k: int) -> float:
        """Saved bytes as a part of the most that a template could save."""
        return round(saved / max(self.most[k], 1), 6)

    def saving(self, block: str, k: int) -> float:
        return self.part(self.size(block) - len(self.given[k].compress(block.encode())), k)

    def align(self, k: int, ids: np.ndarray, item: np.ndarray) -> list[np.ndarray]:
        """For each end in a run of words, the start, missing words, extra words and ruling-out words of the cheapest place of a template.

        A key holds the cost above and the start below, later starts first.
        """
        cost = self.between[k][ids]
        cost[item] = 1
        between = np.concatenate([[0], np.cumsum(cost)]) << _PLACE
        mask, ends = (1 << _PLACE) - 1, np.arange(len(ids) + 1)
        key = mask - ends
        at = {w: np.flatnonzero(ids == w) for w in self.counts[k]}
        for w, missing in zip(self.ids[k], self.costs[k]):
            new = key + (missing << _PLACE)
            hit = at[w]
            new[hit + 1] = np.minimum(new[hit + 1], key[hit])
            new -= between
            key = np.minimum.accumulate(new) + between
        start, cost = mask - (key & mask), key >> _PLACE
        ruled_out, cost = cost // _RULED_OUT, cost % _RULED_OUT
        n_missing = (len(self.ids[k]) - (ends - start) + cost) // (_MISSING + 1)
        return [start, n_missing, ends - start - len(self.ids[k]) + n_missing, ruled_out]

    def places(self, k: int, ids: np.ndarray, item: np.ndarray, held: Counter[int]) -> list[tuple[int, int, int, int]]:
        """Start, end, missing and extra words of each place that confirms a template; ``held`` counts the words."""
        most = MOST_MISSING * len(self.ids[k])
        if sum(max(n - held[w], 0) for w, n in self.counts[k].items()) > most:
            return []
        start, missing, extra, ruled_out = self.align(k, ids, item)
        ends = np.flatnonzero((ruled_out == 0) & (missing <= most) & (extra <= MOST_EXTRA * len(self.ids[k])))
        found: list[tuple[int, int, int, int]] = []
        taken = np.zeros(len(ids), bool)
        for end in ends[np.lexsort((ends, (_MISSING * missing + extra)[ends]))].tolist():
            if end > start[end] and not taken[start[end] : end].any():
                taken[start[end] : end] = True
                found.append((int(start[end]), end, int(missing[end]), int(extra[end])))
        return found

    def judge_piece(self, text: Text, a: int, b: int) -> list[Match]:
        """Confirmed notices among the words from ``a`` to ``b``, and a match that is not confirmed for each rest with a cue."""
        cue = text.cue_in(a, b)
        if cue is None:
            return []
        ids, item, ranked = text.ids[a:b], text.item[a:b], self.rank(text.between(a, b))
        held = Counter(ids.tolist())
        for _, k in ranked:
            if found := sorted(self.places(k, ids, item, held)):
                break
        else:
            saved, k = ranked[0]
            start, missing, extra, ruled_out = self.align(k, ids, item)
            at = np.lexsort((_MISSING * missing + extra, ruled_out))[0]
            return [Match(self.names[k], self.part(saved, k), int(missing[at]), int(extra[at]), False, cue, b, text.line(cue))]
        matches, rest = [], a
        for start, end, missing, extra in found:
            begin, end = a + start, a + end
            matches += self.judge_piece(text, rest, begin)
            matches.append(Match(self.names[k], self.saving(text.between(begin, end), k), missing, extra, True, begin, end, text.line(begin)))
            rest = end
        return matches + self.judge_piece(text, rest, b)

    def judge_tag(self, identifier: str) -> Match:
        """An identifier of a tag: the template that saves most of those with just its words."""
        block = TAG + _LATER.sub("", identifier.rstrip("."))
        words, ranked = wording(block), self.rank(block)
        for saved, k in ranked:
            if self.words[k] == words:
                return Match(self.names[k], self.part(saved, k), 0, 0, True)
        saved, k = ranked[0]
        known, own = Counter(words), Counter(self.words[k])
        return Match(self.names[k], self.part(saved, k), (own - known).total(), (known - own).total(), False)

    def judge_block(self, text: Text, a: int, b: int) -> list[Match]:
        """Matches of a block in parts of bounded length; each part but the last answers for notices that begin before its last ``reach`` words."""
        matches = []
        while b - a > LONGEST:
            sure = a + LONGEST - self.reach
            own = [m for m in self.judge_piece(text, a, a + LONGEST) if m.begin < sure]
            matches += own
            a = max([sure, *(m.end for m in own if m.confirmed)])
        return matches + self.judge_piece(text, a, b)

    def scan(self, text: str) -> list[Match]:
        """Matches of all candidate blocks, by line."""
        held = Text(text, self.cue, self.number)
        matches = [m for a, b in held.blocks(self.reach) for m in self.judge_block(held, a, b)]
        for a, b, expression in held.tags:
            parts = regex.findall(r"[^\s()]+", expression)  # identifiers and exceptions, an operator between any two
            for operator, identifier in zip(["", *parts[1::2]], parts[::2]):
                if operator.upper() != "WITH":
                    found = self.judge_tag(identifier)
                    found.begin, found.end, found.line = a, b, held.line(a)
                    matches.append(found)
        return sorted(matches, key=lambda m: (m.line, not m.confirmed))

    def judge(self, block: str) -> Match:
        """The first confirmed match of a block, or else the first."""
        return min(self.scan(block), key=lambda m: not m.confirmed)


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """One row for each confirmed notice of each document, and for each rest of a candidate block with its best template; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        for part in text_slices(batches):
            part = part.filter(pc.fill_null(pc.match_substring_regex(part.column("text"), CUES), False))
            rows = []
            for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                for m in scanner.scan(text):
                    rows.append((doc, m.line, m.license, m.saving, m.n_missing, m.n_extra, m.confirmed))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 7, _ARROW.types)], schema=_ARROW)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(run, SCHEMA)
