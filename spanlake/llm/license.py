"""License scans by template-markup matching.

A template is license wording with optional regions ``[[ ... ]]`` and replaceable
ones ``{{name:min-max}}`` (any min to max words).  It is compiled to an automaton
over words: mandatory words are single steps, optional regions may be skipped, and
replaceable regions are bounded loops, so a template's longest wording is known.
A text is read from every place from which its rarest mandatory word can be
reached, as far as that longest wording goes, and accepted where all mandatory
wording matched exactly; of matches the leftmost and then longest counts.

Beside the templates there are base phrases, found wherever their words stand
consecutively.  Words are maximal runs of ASCII digits, letters (A-Z lower-cased)
and all characters above ASCII.

The score grows with the mandatory words of the longest wording found: 1 - 2 **
(-words / 3), about 0.4 for a phrase of two words and 1 for a whole license.

Results for odd input: null and empty texts have no words, no labels, null places
and score 0; overlapping places of phrases and overlapping matches of different
templates all count; a text and a template of any length are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.llm.common import slices, texts_of

#: Phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Own templates by label: wording by which texts say under which terms they stand, and whole licenses.
TEMPLATES = {
    "apache-2.0": "licensed under the [[terms of the]] apache license [[,]] [[version]] 2.0",
    "apache-2.0-text": """
        licensed under the apache license version 2.0 the license you may not use {{thing:1-3}} except in compliance with the license
        [[you may obtain a copy of the license at [[{{url:1-8}}]]]] unless required by applicable law or agreed to in writing software distributed
        under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied
        see the license for the specific language governing permissions and limitations under the license""",
    "apache-2.0-notice": "you may not use this {{thing:1-2}} except in compliance with the license",
    "cc-by": "licensed under [[a]] [[the]] [[creative commons]] cc by [[{{variant:1-2}}]] [[{{major:1-1}} 0]] [[international]] [[license]]",
    "cc-by-nc": "licensed under [[a]] [[the]] [[creative commons]] cc by nc [[sa]] [[nd]] {{major:1-1}} {{minor:1-1}}",
    "cc-by-text": "licensed under [[a]] [[the]] creative commons attribution [[noncommercial]] [[sharealike]] [[noderivatives]] [[noderivs]] {{major:1-1}} {{minor:1-1}} [[international]] [[unported]] [[generic]] license",
    "gpl": "licensed under the [[terms of the]] gnu [[lesser]] [[affero]] general public license [[as published by the free software foundation]] [[either]] [[version {{version:1-2}}]]",
    "gpl-3": "licensed under the [[terms of the]] gnu general public license [[,]] version 3",
    "gpl-notice": """
        {{program:0-6}} is free software you can redistribute it and or modify it under the terms of the gnu [[lesser]] [[library]] [[affero]] general public license
        as published by the free software foundation either version {{version:1-2}} of the license or at your option any later version
        {{program2:0-6}} is distributed in the hope that it will be useful but without any warranty without even the implied warranty of
        merchantability or fitness for a particular purpose see the gnu [[lesser]] [[library]] [[affero]] general public license for more details
        [[you should have received a copy of the gnu [[lesser]] [[library]] [[affero]] general public license along with {{program3:0-6}} if not [[see {{url:1-8}}]]]]""",
    "mit": "[[this {{thing:1-3}} is]] released under the [[terms of the]] mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this {{thing:1-4}}",
    "mit-text": """
        [[[[the]] mit license [[mit]]]] [[copyright [[c]] {{holder:1-20}}]]
        permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software
        to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense
        and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions
        the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the software
        the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
        fitness for a particular purpose and noninfringement in no event shall {{holder2:1-12}} be liable for any claim damages or other liability
        whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software""",
    "isc-text": """
        [[isc license]] [[copyright [[c]] {{holder:1-20}}]] permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
        provided that the above copyright notice and this permission notice appear in all copies
        the software is provided as is and {{holder2:1-8}} disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness
        in no event shall {{holder3:1-8}} be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits
        whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software""",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted",
    "bsd-text": """
        [[copyright [[c]] {{holder:1-20}}]] redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
        [[1]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
        [[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
        in the documentation and or other materials provided with the distribution
        [[[[3]] neither the name of {{holder2:1-12}} may be used to endorse or promote products derived from this software without specific prior written permission]]
        this software is provided by {{holder3:1-12}} as is and any express or implied warranties including but not limited to the implied warranties of merchantability
        and fitness for a particular purpose are disclaimed in no event shall {{holder4:1-12}} be liable for any direct indirect incidental special exemplary or consequential damages
        including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability
        whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage""",
    "zlib-text": """
        this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software
        permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions
        [[1]] the origin of this software must not be misrepresented you must not claim that you wrote the original software
        if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required
        [[2]] altered source versions must be plainly marked as such and must not be misrepresented as being the original software
        [[3]] this notice may not be removed or altered from any source distribution""",
    "unlicense-text": """
        this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software
        either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means""",
    "spdx": "spdx license identifier {{name:1-1}}",
    "reserved": "[[copyright [[c]] {{holder:1-6}}]] all rights reserved",
}

IS_WORD = np.zeros(256, bool)
IS_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
GAP = rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text: str) -> bytes:
    """UTF-8 with A-Z lower-cased and nothing else."""
    return text.encode("utf-8", "surrogatepass").lower()


def phrase_pattern(phrase: str) -> re.Pattern:
    """Finds a phrase at word borders; its first word is the match, the rest is looked at, so that matches may overlap."""
    first, *rest = (re.escape(w) for w in phrase.encode().split())
    return re.compile(rb"(?<![0-9a-z\x80-\xff])" + first + rb"(?=" + b"".join(GAP + w for w in rest) + rb"(?![0-9a-z\x80-\xff]))")


class Automaton:
    """A template's states and steps.

    ``words[state]`` maps a word to the states after it, ``any_word[state]`` are
    the states after whatever word; optional parts are resolved when compiling.
    """

    def __init__(self, template: str):
        self.next: list[dict[str | None, set[int]]] = [{}]
        ends = self._parts(self._tokens(template), {0})
        self.accepting = ends
        self.anchors = self._mandatory(template)
        # steps lead to later states only, so one pass in order finds the longest wording
        far = [0] * len(self.next)
        for s, steps in enumerate(self.next):
            for t in set().union(*steps.values()):
                far[t] = max(far[t], far[s] + 1)
        self.longest = max(far[s] for s in ends)

    @staticmethod
    def _tokens(template: str) -> list[str]:
        return re.findall(r"\[\[|\]\]|\{\{.*?\}\}|[a-z0-9]+", template)

    @classmethod
    def _mandatory(cls, template: str) -> list[str]:
        """The words outside optional regions."""
        out, depth = [], 0
        for t in cls._tokens(template):
            depth += (t == "[[") - (t == "]]")
            if not depth and t[0].isalnum():
                out.append(t)
        return out

    def _state(self, before: set[int], word: str | None) -> set[int]:
        self.next.append({})
        for s in before:
            self.next[s].setdefault(word, set()).add(len(self.next) - 1)
        return {len(self.next) - 1}

    def _parts(self, tokens: list[str], at: set[int]) -> set[int]:
        k = 0
        while k < len(tokens):
            if tokens[k] == "[[":
                depth, end = 1, k + 1
                while depth:
                    depth += (tokens[end] == "[[") - (tokens[end] == "]]")
                    end += 1
                at = at | self._parts(tokens[k + 1 : end - 1], at)
                k = end
                continue
            if tokens[k].startswith("{{"):
                low, high = map(int, tokens[k][2:-2].rpartition(":")[2].split("-"))
                ends: set[int] = set() if low else set(at)
                for n in range(1, high + 1):
                    at = self._state(at, None)
                    if n >= low:
                        ends |= at
                at = ends
            else:
                at = self._state(at, tokens[k])
            k += 1
        return at

    def match(self, words: list[str], start: int) -> int:
        """Where the longest match from ``start`` ends (exclusive), -1 if there is none."""
        live, end, k = {0}, -1, start
        while live and k < len(words):
            after: set[int] = set()
            for s in live:
                step = self.next[s]
                after |= step.get(words[k], set()) | step.get(None, set())
            live, k = after, k + 1
            if live & self.accepting:
                end = k
        return end


class Scanner:
    """All templates and base phrases; texts without a template's rarest word don't run its automaton."""

    def __init__(self, templates: dict[str, str] | None = None, base: dict[str, str] | None = None):
        self.base = [(label, phrase_pattern(p), len(p.split())) for p, label in (BASE if base is None else base).items()]
        self.automata = []
        for label, template in (TEMPLATES if templates is None else templates).items():
            a = Automaton(template)
            anchor = max(a.anchors, key=len)
            lead = at = 0  # words that may stand before the anchor's last place
            for t in a._tokens(template):
                if t == anchor:
                    lead = at
                at += int(t[2:-2].rpartition("-")[2]) if t.startswith("{{") else t[0].isalnum()
            self.automata.append((label, a, anchor.encode(), lead, len(a.anchors)))

    def scan(self, text: str) -> tuple[int, int, int | None, int | None, list[str], list[str], float, list[tuple[str, int, int]]]:
        """n_words, n_base, first_word, last_word, base labels, all labels, score, template matches (label, from, to by word)."""
        raw = lowered(text)
        inside = IS_WORD[np.frombuffer(raw, np.uint8)]
        n_words = int(np.count_nonzero(inside[1:] & ~inside[:-1])) + bool(len(inside) and inside[0])
        starts, labels, wording = [], set(), 0
        for label, pattern, size in self.base:
            found = [m.start() for m in pattern.finditer(raw)]
            starts += found
            if found:
                labels.add(label)
                wording = max(wording, size)
        begin = None
        matches: list[tuple[str, int, int]] = []
        for label, automaton, anchor, lead, size in self.automata:
            if anchor not in raw:
                continue
            if begin is None:
                begin = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
            places = sorted({int(np.searchsorted(begin, m.start())) for m in re.finditer(rb"(?<![0-9a-z\x80-\xff])" + anchor + rb"(?![0-9a-z\x80-\xff])", raw)})
            done = -1
            for place in places:
                if place < done:
                    continue
                low = max(0, place - lead, done)
                far = place + automaton.longest
                window = raw[begin[low] : begin[far]] if far < len(begin) else raw[begin[low] :]
                words = [w.decode("utf-8", "replace") for w in WORD.findall(window)]
                for at in range(place - low + 1):
                    if (end := automaton.match(words, at)) > place - low:
                        matches.append((label, low + at, low + end))
                        done, wording = low + end, max(wording, size)
                        break
        if starts:
            if begin is None:
                begin = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
            words = np.searchsorted(begin, np.array(starts))
            first, last = int(words.min()), int(words.max())
        else:
            first = last = None
        every = sorted(labels | {m[0] for m in matches})
        return n_words, len(starts), first, last, sorted(labels), every, 1 - 2 ** (-wording / 3), matches


def scan(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), templates: dict[str, str] | None = None, base: dict[str, str] | None = None) -> DataFrame:
    """``keep`` columns with n_words, n_base, first_word, last_word, base_labels, labels, score and matches.

    Labels are distinct, sorted and comma-joined; ``matches`` lists template
    matches as label:from:to by word, in order.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import DoubleType, LongType, StringType, StructType

    out = StructType([df.schema[c] for c in keep])
    made = (("n_words", LongType()), ("n_base", LongType()), ("first_word", LongType()), ("last_word", LongType()), ("base_labels", StringType()), ("labels", StringType()), ("score", DoubleType()), ("matches", StringType()))
    for name, kind in made:
        out = out.add(name, kind)
    schema = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, base)
        for batch in batches:
            for part in slices(batch, 4_000_000, "__spanlake_text"):
                rows = []
                for t in texts_of(part, "__spanlake_text"):
                    n, nb, first, last, bl, al, score, matches = scanner.scan(t)
                    rows.append((n, nb, first, last, ",".join(bl), ",".join(al), score, ",".join(f"{x}:{a}:{b}" for x, a, b in sorted(matches, key=lambda m: (m[1], m[0])))))
                cols = list(zip(*rows, strict=True)) if rows else [[] for _ in made]
                yield pa.RecordBatch.from_arrays([*(part[c].cast(schema.field(c).type) for c in keep), *(pa.array(x, schema.field(c).type) for (c, _), x in zip(made, cols, strict=True))], schema=schema)

    return df.select(*keep, F.col(text).alias("__spanlake_text")).mapInArrow(run, out)
