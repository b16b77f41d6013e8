"""License scans by template-markup matching.

A template is the wording of a notice with optional regions, [[...]], and replaceable regions,
{{n}}, of at most n words. It is compiled to a token automaton; a text is accepted where every
mandatory word stands in order and nothing stands between them that the markup doesn't allow. Texts
are searched for the first mandatory words of all templates by hash; automata run from those places, and
from the few words before them that regions at a template's head may take.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as k
from .common import internal, table

#: The phrases of the base scan and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Wordings that several templates share.
_MIT_WARRANTY = "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
_ISC_GRANT = "permission to use copy modify and [[or]] distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"
_BSD_TWO = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met [[1]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer [[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
_BSD_THREE = f"{_BSD_TWO} [[3]] neither the name of {{{{12}}}} may be used to endorse or promote products derived from this software"
_BSD_WARRANTY = "this software is provided by {{8}} as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall {{8}} be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
_GPL_GRANT = "this program is free software you can redistribute it and or modify it under the terms of the gnu [[lesser]] [[affero]] general public license as published by the free software foundation"

#: Public wordings of license notices, grants and whole texts.
TEMPLATES = {
    "apache-2.0-notice": "licensed under the apache license version 2 0",
    "mit-notice": "released under the mit license",
    "gpl-notice": "licensed under the [[terms of the]] gnu [[lesser]] [[affero]] general public license [[version {{2}}]]",
    "cc-by-notice": "licensed under [[a]] [[the]] creative commons attribution [[{{3}} international]] [[license]]",
    "all-rights-reserved": "all rights reserved",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of {{8}} to deal in {{4}} without restriction [[including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of {{4}}]]",
    "isc-text": _ISC_GRANT,
    "bsd-2-clause-text": _BSD_TWO,
    "bsd-3-clause-text": _BSD_THREE,
    "apache-2.0-header": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
    "gpl-header": _GPL_GRANT,
    "mit-full": f"[[the]] [[mit license]] [[copyright [[c]] {{{{8}}}}]] permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the software {_MIT_WARRANTY}",
    "isc-full": f"[[isc license]] [[copyright [[c]] {{{{8}}}}]] {_ISC_GRANT} the software is provided as is and {{{{4}}}} disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall {{{{4}}}} be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    "bsd-2-clause-full": f"{_BSD_TWO} {_BSD_WARRANTY}",
    "bsd-3-clause-full": f"{_BSD_THREE} without specific prior written permission {_BSD_WARRANTY}",
    "apache-2.0-header-full": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    "gpl-header-full": f"{_GPL_GRANT} either version {{{{1}}}} of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu [[lesser]] [[affero]] general public license for more details [[you should have received a copy of the gnu [[lesser]] [[affero]] general public license along with this program [[if not see {{{{6}}}}]]]]",
}

ANY = None


@dataclass
class Automaton:
    """step[s]: word hash (or ANY) and next state of the edges of s; skip[s]: states reached for nothing.

    head: the first mandatory words, up to three that stand side by side; before: words that regions before it may take.
    """

    label: str
    head: list[int]
    before: int
    mandatory: int
    step: list[list[tuple[int | None, int]]] = field(default_factory=lambda: [[]])
    skip: list[list[int]] = field(default_factory=lambda: [[]])
    #: Most mandatory words read on the way to a state.
    depth: list[int] = field(default_factory=lambda: [0])

    def state(self, depth: int) -> int:
        self.step.append([])
        self.skip.append([])
        self.depth.append(depth)
        return len(self.step) - 1

    def reach(self, states: set[int]) -> set[int]:
        todo, seen = list(states), set(states)
        while todo:
            for t in self.skip[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return seen

    def run(self, words: list[int]) -> tuple[int, int]:
        """Words of the longest accepted match from the first word on (0: none), and most mandatory words met."""
        states, end, far, final = self.reach({0}), 0, 0, len(self.step) - 1
        for n, w in enumerate(words, 1):
            states = self.reach({t for s in states for edge, t in self.step[s] if edge is ANY or edge == w})
            if not states:
                break
            far = max(far, max(self.depth[s] for s in states))
            if final in states:
                end = n
        return end, far


def hashes(text: str) -> list[int]:
    (part,) = k.slices(pa.array([text]))
    return k.words(part, k.NOT_ALNUM, lower=True).hash.tolist()


def compile_template(label: str, markup: str) -> Automaton:
    """The automaton of a template. One without a mandatory word would accept an empty text, so it is an error."""
    tokens = re.findall(r"\[\[|\]\]|\{\{\d+\}\}|[^\s\[\]{}]+", markup)
    head, before, mandatory, deep, side = [], 0, 0, 0, True
    for t in tokens:
        deep += (t == "[[") - (t == "]]")
        word = t[0] not in "[]{"
        if word and not deep:
            mandatory += 1
            if side and len(head) < 3:
                head += hashes(t)
        elif head:
            side = False  # the words after a region don't stand beside those before it
        else:
            before += 1 if word else int(t[2:-2]) if t[0] == "{" else 0
    if not head:
        raise ValueError(f"template {label} has no mandatory word")
    out, at, opened, depth = Automaton(label, head, before, mandatory), 0, [], 0
    for t in tokens:
        if t == "[[":
            opened.append(at)
        elif t == "]]":
            last, at = at, out.state(depth)
            out.skip[opened.pop()].append(at)
            out.skip[last].append(at)
        elif t[0] == "{":
            entry = at
            ends = [entry]
            for _ in range(int(t[2:-2])):
                following = out.state(depth)
                out.step[ends[-1]].append((ANY, following))
                ends.append(following)
            at = out.state(depth)
            for s in ends:
                out.skip[s].append(at)
        else:
            depth += not opened
            following = out.state(depth)
            out.step[at].append((hashes(t)[0], following))
            at = following
    if out.skip[at] or out.step[at] or at != len(out.step) - 1:  # the last state made is the final one
        out.skip[at].append(out.state(depth))
    return out


def places(w: k.Words, left: np.ndarray, phrase: list[int]) -> np.ndarray:
    """Words at which the phrase stands, whole, inside one text."""
    at = np.flatnonzero(w.hash == np.uint64(phrase[0]))
    at = at[left[at] >= len(phrase)]
    for i, h in enumerate(phrase[1:], 1):
        at = at[w.hash[at + i] == np.uint64(h)]
    return at


_MATCH = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
_OUT = "doc_id long, n_words long, matches array<struct<label: string, start: long, end: long, base: boolean>>, partial double"


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """All matches of every whole text: label, first word, word after the last, and whether it is of the base scan.

    partial is the largest share of a template's mandatory words that stood in order at some place. A null
    text counts as empty; it has no match.
    """
    automata = [compile_template(*x) for x in (TEMPLATES if templates is None else templates).items()]
    phrases = [(label, hashes(p)) for p, label in PHRASES.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in k.slices(batch.column("text")):
                w = k.words(part, k.NOT_ALNUM, lower=True)
                left = w.left()
                found: list[list[dict]] = [[] for _ in range(len(part))]
                share = np.zeros(len(part))

                def add(at: int, end: int, label: str, base: bool, w: k.Words = w, found: list = found) -> None:
                    i = int(np.searchsorted(w.first, at, "right")) - 1
                    found[i].append({"label": label, "start": int(at - w.first[i]), "end": int(end - w.first[i]), "base": base})

                for label, phrase in phrases:
                    for at in places(w, left, phrase):
                        add(at, at + len(phrase), label, True)
                for a in automata:
                    ended = -1
                    for at in places(w, left, a.head).tolist():
                        i = int(np.searchsorted(w.first, at, "right")) - 1
                        for start in range(max(int(w.first[i]), at - a.before), at + 1):  # the longest match has the first start
                            n, far = a.run(w.hash[start : start + min(int(left[start]), len(a.step))].tolist())
                            share[i] = max(share[i], far / a.mandatory)
                            if n:
                                if start + n != ended:
                                    add(start, start + n, a.label, False)
                                ended = start + n
                                break
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(part.first, len(part)), pa.array(w.count), pa.array(found, _MATCH), pa.array(share)], ["doc_id", "n_words", "matches", "partial"]
                )

    return internal(docs, "doc_id", "text").mapInArrow(run, _OUT)


def op7_license_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """score: 1 for an accepted template, half for a base phrase alone, else half the best partial share."""
    found = scan(table(spark, sf_dir, "documents"))
    base = F.filter("matches", lambda m: m["base"])
    labels = lambda col: F.array_join(F.array_sort(F.array_distinct(F.transform(col, lambda m: m["label"]))), ",")
    starts = F.transform(base, lambda m: m["start"])
    accepted = F.exists("matches", lambda m: ~m["base"])
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("matches")).alias("labels"),
        F.when(accepted, 1.0).when(F.size(base) > 0, 0.5).otherwise(F.col("partial") / 2).alias("score"),
    )
