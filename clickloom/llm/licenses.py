"""License scans by template markup.

A template is license wording with marked regions: ``<<opt>> ... <<end>>`` may be left
out, ``<<var N>>`` stands for up to N words of any kind.  All other words are
mandatory and must occur exactly, one after another.  A template compiles into an
automaton over word tokens whose states are places in the wording; optional
regions add empty moves, replaceable regions add states that take any word.  A text is
accepted where a run of its words leads from the first to the last state.

Words are runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` in the text with A-Z in lower case.
An automaton runs only where its anchor (the first mandatory words) stands, so a text
without an anchor costs one search.

Short licenses and file headers are written out in ``TEMPLATES``.  Whole license texts lie
verbatim in the folder ``wording``; ``body_template`` makes templates of them: the words between two
markers, where numbers and letters of list items may be left out.

Base places are those of four fixed phrases.  The score of a document is 0 without any
finding, 0.5 for base phrases alone, and else the share of mandatory words in the
longest accepted stretch, scaled to lie between 0.5 and 1.

Defined cases: a null or empty text has no words and no finding; repeated rows
and null ids give a row each; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from importlib import resources

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Base phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
_HOLDER = "<<opt>> copyright <<var 16>> <<end>>"
_NO_WARRANTY = (
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of "
    "merchantability fitness for a particular purpose and noninfringement in no event shall the authors <<opt>> or copyright holders <<end>> be "
    "liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in "
    "connection with the software or the use or other dealings in the software"
)
_BSD = (
    f"{_HOLDER} <<opt>> all rights reserved <<end>> redistribution and use in source and binary forms with or without modification are permitted provided that the "
    "following conditions are met <<var 2>> redistributions of source code must retain the above copyright notice this list of "
    "conditions and the following disclaimer <<var 2>> redistributions in binary form must reproduce the above copyright notice "
    "this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
)
_BSD_NAMES = "<<var 2>> neither the name of <<var 16>> may be used to endorse or promote products derived from this software without specific prior written permission"
_BSD_END = (
    "this software is provided by <<var 16>> as is and any express or implied warranties including but not limited to the implied "
    "warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall <<var 16>> be liable for any direct "
    "indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or "
    "services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract "
    "strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of "
    "the possibility of such damage"
)
_GPL_HEAD = "free software you can redistribute it and or modify it under the terms of the gnu"
_GPL_REST = (
    "of the license or at your option any later version <<var 8>> distributed in the hope that it will be useful but without any warranty "
    "without even the implied warranty of merchantability or fitness for a particular purpose see the gnu"
)
#: Public license wording with optional and replaceable regions.  Names that end in "notice" stand for a mention.
TEMPLATES = {
    "MIT": f"{_HOLDER} permission is hereby granted free of charge to any person obtaining a copy of this software and "
    "associated documentation files the <<opt>> quot <<end>> software <<opt>> quot <<end>> to deal in the software without restriction including without limitation the "
    "rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to "
    "whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission "
    f"notice <<opt>> including the next paragraph <<end>> shall be included in all copies or substantial portions of the software {_NO_WARRANTY}",
    "ISC": f"{_HOLDER} permission to use copy modify and <<opt>> or <<end>> distribute this software for any purpose with or without fee is hereby granted "
    "provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author "
    "disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall "
    "the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or "
    "profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    "BSD-2-Clause": f"{_BSD} {_BSD_END}",
    "BSD-3-Clause": f"{_BSD} {_BSD_NAMES} {_BSD_END}",
    "Zlib": f"{_HOLDER} this software is provided as is without any express or implied warranty in no event will the authors be held liable "
    "for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including "
    "commercial applications and to alter it and redistribute it freely subject to the following restrictions <<var 1>> the origin of this "
    "software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an "
    "acknowledgment in the product documentation would be appreciated but is not required <<var 1>> altered source versions must be plainly "
    "marked as such and must not be misrepresented as being the original software <<var 1>> this notice may not be removed or altered from any source distribution",
    "Unlicense": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or "
    "distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means "
    "in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the "
    "software to the public domain we make this dedication for the benefit of the public at large and to the detriment of our heirs and "
    "successors we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software "
    f"under copyright law {_NO_WARRANTY}",
    "Apache-2.0": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may "
    "obtain a copy of the license at <<opt>> http <<end>> <<opt>> https <<end>> <<opt>> www <<end>> apache org licenses license 2 0 unless required by applicable law or agreed to in "
    "writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either "
    "express or implied see the license for the specific language governing permissions and limitations under the license",
    "GPL-2.0-or-later": f"{_GPL_HEAD} general public license as published by the free software foundation either version 2 {_GPL_REST} general public license for more details",
    "GPL-3.0-or-later": f"{_GPL_HEAD} general public license as published by the free software foundation either version 3 {_GPL_REST} general public license for more details",
    "AGPL-3.0-or-later": f"{_GPL_HEAD} affero general public license as published by the free software foundation either version 3 {_GPL_REST} affero general public license for more details",
    "LGPL-2.1-or-later": f"{_GPL_HEAD} lesser general public license as published by the free software foundation either version 2 1 {_GPL_REST} lesser general public license for more details",
    "MPL-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this "
    "file you can obtain one at <<opt>> http <<end>> <<opt>> https <<end>> <<opt>> www <<end>> mozilla org mpl 2 0",
    "Apache-2.0-notice": "licensed under the apache license <<opt>> version <<end>> 2 0",
    "GPL-2.0-notice": "<<opt>> licensed under the <<end>> gnu general public license <<opt>> as published by the free software foundation either <<end>> version 2",
    "GPL-3.0-notice": "<<opt>> licensed under the <<end>> gnu general public license <<opt>> as published by the free software foundation either <<end>> version 3",
    "LGPL-notice": "gnu <<opt>> lesser <<end>> <<opt>> library <<end>> general public license <<opt>> as published by the free software foundation either <<end>> version 2 1",
    "MIT-notice": "<<opt>> released under the <<end>> <<opt>> licensed under the <<end>> mit license",
    "CC-BY-notice": "licensed under <<opt>> a <<end>> <<opt>> the <<end>> cc by 4 0",
    "CC-BY-NC-notice": "licensed under <<opt>> a <<end>> <<opt>> the <<end>> cc by nc 4 0",
    "CC-BY-SA-notice": "licensed under <<opt>> a <<end>> <<opt>> the <<end>> cc by sa 4 0",
    "CC-BY-ND-notice": "licensed under <<opt>> a <<end>> <<opt>> the <<end>> cc by nd 4 0",
    "MPL-2.0-notice": "mozilla public license <<opt>> version <<end>> <<opt>> v <<end>> 2 0",
    "CC0-1.0-notice": "<<opt>> creative commons <<end>> <<opt>> licensed under <<end>> cc0 1 0 <<opt>> universal <<end>>",
    "CC-4.0-notice": "licensed under a creative commons attribution <<var 4>> 4 0 international license",
}
#: The label of each whole text in ``wording``, its file, and the words where its terms begin and before which they end.
FULL_TEXTS = {
    "Apache-2.0": ("Apache-2.0.txt", "Definitions.", "END OF TERMS AND CONDITIONS"),
    "CC0-1.0": ("CC0-1.0.txt", "Statement of Purpose", None),
    "GPL-2.0": ("GPL-2.txt", "TERMS AND CONDITIONS FOR COPYING", "END OF TERMS AND CONDITIONS"),
    "GPL-3.0": ("GPL-3.txt", "Definitions.", "END OF TERMS AND CONDITIONS"),
    "LGPL-2.1": ("LGPL-2.1.txt", "TERMS AND CONDITIONS FOR COPYING", "END OF TERMS AND CONDITIONS"),
    "LGPL-3.0": ("LGPL-3.txt", "This version of the GNU Lesser General Public License incorporates", None),
    "MPL-2.0": ("MPL-2.0.txt", '"Contributor"', "Exhibit A - Source Code Form License Notice"),
}
SEPARATOR = r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+"
EDGE = r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]"
UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


class Automaton:
    """Token automaton of one template: ``moves[i]`` is (token, next) or any-word moves, ``skips[i]`` the empty moves."""

    def __init__(self, template: str):
        self.words: list[tuple[str | None, int]] = []  # token (None: any word) and where it leads
        self.skips: dict[int, list[int]] = {}
        opened: list[int] = []
        mandatory: list[str] = []
        marks = re.findall(r"<<[^>]*>>|\S+", template)
        at = 0
        for mark in marks:
            if mark == "<<opt>>":
                opened.append(at)
            elif mark == "<<end>>":
                self.skips.setdefault(opened.pop(), []).append(at)
            elif mark.startswith("<<var"):
                for _ in range(int(mark[5:-2])):
                    self.skips.setdefault(at, []).append(at + 1)
                    self.words.append((None, at + 1))
                    at += 1
            else:
                if not opened:
                    mandatory.append(mark)
                self.words.append((mark, at + 1))
                at += 1
        self.final, self.mandatory = at, len(mandatory)
        # the anchor: the first mandatory words that no region parts
        first = re.split(r"<<[^>]*>>", re.sub(r"<<opt>>.*?<<end>>", "<<gap>>", template))
        self.anchor = tuple(next(x.split() for x in first if x.split())[:4])
        # optional words before the anchor, all of which a run may begin with
        before = re.findall(r"<<var \d+>>|\S+", re.sub(r"<<opt>>|<<end>>", "", template.split(" ".join(self.anchor))[0]))
        self.lead = sum(int(x[5:-2]) if x.startswith("<<var") else 1 for x in before)

    def _closed(self, states: set[int]) -> set[int]:
        todo, found = [*states], set(states)
        while todo:
            for t in self.skips.get(todo.pop(), ()):
                if t not in found:
                    found.add(t)
                    todo.append(t)
        return found

    def longest(self, words: list[str], start: int) -> int:
        """End of the longest accepted run of ``words`` from ``start``; -1 without one."""
        states, end, i = self._closed({0}), -1, start
        while True:
            if self.final in states:
                end = i
            if i >= len(words) or not states:
                return end
            step = {self.words[s][1] for s in states if s < self.final and self.words[s][0] in (None, words[i])}
            states, i = self._closed(step), i + 1


def _phrase(words) -> str:
    return SEPARATOR.join(map(re.escape, words))


def body_template(text: str, begin: str, end: str | None) -> str:
    """A template of the words of ``text`` from ``begin`` to before ``end``; list numbers and letters at the head of a line are optional."""
    body = text[text.index(begin) : text.index(end) if end else None]
    parts, blank = [], True
    for line in body.split("\n"):
        number = re.match(r"\s*\d+(?:\.\d+)*[.)]\s", line) if blank else None  # elsewhere a number at the head of a line belongs to a sentence
        item = number or re.match(r"\s*(?:\(?(?:[a-z]|[ivx]+)\)|(?:[a-z]|[ivx]+)\.)\s", line)
        cut, blank = item.end() if item else 0, not line.strip()
        numbers, words = (re.findall(f"{EDGE}+", x.encode().translate(UPPER).decode()) for x in (line[:cut], line[cut:]))
        parts += ["<<opt>>", *numbers, "<<end>>"] * bool(numbers) + words
    return " ".join(parts)


def _wording(file: str) -> str:
    return resources.files(__package__).joinpath("wording", file).read_text("utf-8")


#: (label, automaton) of all templates; a label may have a file header and a whole text.
AUTOMATA = [(k, Automaton(v)) for k, v in TEMPLATES.items()] + [
    (k, Automaton(body_template(_wording(file), begin, end))) for k, (file, begin, end) in FULL_TEXTS.items()
]
_BASE = re.compile(f"(?<!{EDGE})(?:" + "|".join(f"({_phrase(p.split())})" for p in PHRASES) + f")(?!{EDGE})")
_ANCHORS = [re.compile(f"(?<!{EDGE}){_phrase(a.anchor)}(?!{EDGE})") for _, a in AUTOMATA]
_ANY_ANCHOR = re.compile("licens|permission|redistribut|unencumbered|warranty")


def scan_text(text: str | None) -> tuple[int, int, int | None, int | None, str, str, float]:
    """n_words, n_base, first_word, last_word, base_labels, labels, score of one text."""
    raw = (text or "").encode("utf-8", "replace").translate(UPPER)
    is_word = _IS_WORD[np.frombuffer(raw, np.uint8)]
    starts = is_word.copy()
    starts[1:] &= ~is_word[:-1]
    n_words = int(np.count_nonzero(starts))
    low = raw.decode("utf-8", "replace")
    if not (_ANY_ANCHOR.search(low) or "cc" in low):
        return n_words, 0, None, None, "", "", 0.0
    places = [(m.start(), m.lastindex - 1) for m in _BASE.finditer(low)]
    anchors = [(automaton, [m.start() for m in r.finditer(low)]) for automaton, r in zip(AUTOMATA, _ANCHORS)]
    anchors = [(automaton, ats) for automaton, ats in anchors if ats]
    if not places and not anchors:
        return n_words, 0, None, None, "", "", 0.0
    words = re.findall(EDGE + "+", low)
    begin = np.array([m.start() for m in re.finditer(EDGE + "+", low)], np.int64)
    index = lambda at: int(np.searchsorted(begin, at))
    names = [*PHRASES.values()]
    base = {names[k] for _, k in places}
    numbers = [index(at) for at, _ in places]
    labels, best = set(base), 0.5 if places else 0.0
    for (k, automaton), ats in anchors:
        for at in ats:
            i = index(at)
            ends = [(automaton.longest(words, j), j) for j in range(max(0, i - automaton.lead), i + 1)]
            end, start = max(ends, key=lambda e: (e[0] >= 0, e[0] - e[1]))
            if end >= 0:
                labels.add(k)
                best = max(best, 0.5 + 0.5 * automaton.mandatory / max(end - start, automaton.mandatory))
    return n_words, len(places), min(numbers, default=None), max(numbers, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), best


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def license_scan(docs: DataFrame) -> DataFrame:
    """Base places, labels and score of each row of ``docs`` (doc_id, text)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.float64()]
        names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
        for batch in batches:
            found = [scan_text(x.as_py()) for x in batch.column(1)]
            columns = list(zip(*found)) if found else [[]] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), k) for c, k in zip(columns, kinds))], names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(scan, SCHEMA)
