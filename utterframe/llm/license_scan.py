"""License scans by template-markup matching.

A template is wording with ``[[optional]]`` regions and ``{{n}}`` replaceable ones (up to n words).
It is compiled into an automaton over words; a text is accepted where the mandatory wording stands
word for word, whatever the regions hold.  There are templates of whole licenses and of the notices
that refer to them.  All automata are tried at the places of their first
words only.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import cache
from importlib import resources
from math import prod

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A-Z to lower case, other ASCII that is neither letter nor digit to a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))

MARKUP = re.compile(r"(\[\[|\]\]|\{\{\d+\}\})")

# Phrases of the base and their labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

# Wording of common notices, with markup.  Whole licenses are files beside this module, named after their label.
NOTICES = (
    ("mit", "released under the [[terms of the]] mit license"),
    ("mit", "licensed under the [[terms of the]] mit license"),
    ("apache-2", "licensed under the apache license version 2 [[0]] [[the license]]"),
    (
        "apache-2",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at {{8}} "
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any "
        "kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    ),
    ("apache-2", "[[this {{4}} is]] released under the apache license version 2 [[0]]"),
    ("apache-2", "apache license version 2 0 january 2004"),
    ("cc-by-nc", "[[this work is]] licensed under [[a]] [[creative commons]] cc by nc [[4 0]]"),
    ("cc-by-nc", "[[this work is]] licensed under a creative commons attribution noncommercial [[{{1}} 0]] [[international]] license"),
    ("cc-by-sa", "[[this work is]] licensed under [[a]] [[creative commons]] cc by sa [[4 0]]"),
    ("cc-by-sa", "[[this work is]] licensed under a creative commons attribution sharealike [[{{1}} 0]] [[international]] license"),
    ("cc-by", "[[this work is]] licensed under a creative commons attribution [[{{1}} 0]] [[international]] license"),
    ("gpl-2", "[[this {{4}} is]] licensed under the [[terms of the]] gnu general public license version 2"),
    ("gpl-3", "[[this {{4}} is]] licensed under the [[terms of the]] gnu general public license version 3"),
    ("gpl-3", "gnu general public license version 3 29 june 2007"),
    (
        "gpl-2",
        "is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 "
        "of the license or [[at your option]] any later version",
    ),
    (
        "gpl-3",
        "is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 "
        "of the license or [[at your option]] any later version",
    ),
    (
        "agpl-3",
        "is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either "
        "version 3 of the license or [[at your option]] any later version",
    ),
    (
        "lgpl-2.1",
        "is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either "
        "version 2 1 of the license or [[at your option]] any later version",
    ),
    ("lgpl-3", "licensed under the [[terms of the]] gnu lesser general public license version 3"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 [[if a copy of the mpl was not distributed with this file you can obtain one at {{5}}]]"),
    ("bsl-1", "distributed under the boost software license version 1 0"),
    ("cc0", "to the extent possible under law {{12}} has waived all copyright and related or neighboring rights to"),
)


@cache
def templates() -> tuple[tuple[str, str], ...]:
    """Notices and whole licenses as ``(label, wording with markup)``; read where the plan is made, and sent along with it."""
    folder = resources.files(__package__) / "licenses"
    whole = sorted((f.name.removesuffix(".txt"), f.read_text()) for f in folder.iterdir() if f.name.endswith(".txt"))
    return (*NOTICES, *whole)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(FOLD).split()


@dataclass
class Automaton:
    """Transitions of a template: from a state by a word, by any word, or freely; the last state accepts."""

    label: str
    words: list[dict[bytes, int]] = field(default_factory=list)
    any: list[int | None] = field(default_factory=list)
    free: list[list[int]] = field(default_factory=list)
    wording: list[bytes] = field(default_factory=list)

    @property
    def mandatory(self) -> int:
        return len(self.wording)

    @staticmethod
    def compile(label: str, template: str) -> Automaton:
        auto = Automaton(label)
        auto._state()
        parts = [p for piece in MARKUP.split(template) for p in ([piece] if MARKUP.fullmatch(piece) else [w.decode() for w in words_of(piece)])]
        auto._read(parts, 0, 0)
        return auto

    def _state(self) -> int:
        self.words.append({})
        self.any.append(None)
        self.free.append([])
        return len(self.words) - 1

    def _read(self, parts: list[str], at: int, depth: int) -> int:
        """Append the parts from ``at`` up to the end of the region; the place after it."""
        opened = len(self.words) - 1
        while at < len(parts):
            p = parts[at]
            if p == "[[":
                start = len(self.words) - 1
                at = self._read(parts, at + 1, depth + 1)
                self.free[start].append(len(self.words) - 1)
                continue
            if p == "]]":
                if not depth:
                    raise ValueError("a region ends that has not begun")
                # a state of its own, so that skipping the region cannot enter what follows it twice
                here = len(self.words) - 1
                self.free[here].append(self._state())
                return at + 1
            if p.startswith("{{"):
                start = len(self.words) - 1
                steps = [start]
                for _ in range(int(p[2:-2])):
                    here = len(self.words) - 1
                    self.any[here] = self._state()
                    steps.append(self.any[here])
                for s in steps[:-1]:
                    self.free[s].append(steps[-1])
            else:
                here = len(self.words) - 1
                self.words[here][p.encode()] = self._state()
                if not depth:
                    self.wording.append(p.encode())
            at += 1
        if depth:
            raise ValueError(f"a region that began at state {opened} does not end")
        return at

    def closure(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in states:
                    states.add(s)
                    todo.append(s)
        return states

    def firsts(self) -> set[bytes] | None:
        """The words a match can begin with; None if any word can."""
        start = self.closure({0})
        return None if any(self.any[s] is not None for s in start) else {w for s in start for w in self.words[s]}

    def match(self, words: list[bytes], at: int) -> int | None:
        """End of the longest accepted run of words from ``at``, or None."""
        states, end, last = self.closure({0}), None, len(self.words) - 1
        while states:
            if last in states:
                end = at
            if at == len(words):
                break
            w = words[at]
            states = self.closure({t for s in states for t in (self.words[s].get(w), self.any[s]) if t is not None})
            at += 1
        return end


class Scanner:
    def __init__(self, wanted: Sequence[tuple[str, str]] | None = None, phrases: Sequence[tuple[str, str]] = PHRASES):
        self.phrases = [(b" " + p.encode() + b" ", label, len(p.split())) for p, label in phrases]
        self.automata = [Automaton.compile(label, t) for label, t in (templates() if wanted is None else wanted)]
        self.by_first: dict[bytes, list[Automaton]] = defaultdict(list)
        for a in self.automata:
            firsts = a.firsts()
            if not firsts or not a.mandatory:
                raise ValueError("a template must begin with wording and have some that is mandatory")
            for w in firsts:
                self.by_first[w].append(a)
        # a text without the longest mandatory word of any template has none
        self.needs = {max(a.wording, key=lambda w: (len(w), w)) for a in self.automata}

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int, str]], list[tuple[int, int, str, int]]]:
        """Number of words, places of phrases ``(first word, end, label)``, accepted regions ``(first word, end, label, mandatory words)``."""
        words = words_of(text)
        joined = b" " + b" ".join(words) + b" "
        places = []
        for phrase, label, n in self.phrases:
            at = joined.find(phrase)
            last, index = 0, 0
            while at >= 0:
                index += joined.count(b" ", last, at)
                last = at
                places.append((index, index + n, label))
                at = joined.find(phrase, at + 1)
        regions = []
        if not self.needs.isdisjoint(words):
            for i, w in enumerate(words):
                for auto in self.by_first.get(w, ()):
                    if end := auto.match(words, i):
                        regions.append((i, end, auto.label, auto.mandatory))
        return len(words), sorted(places), regions


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", wanted: Sequence[tuple[str, str]] | None = None, phrases: Sequence[tuple[str, str]] = PHRASES) -> DataFrame:
    """``(id, n_words, places, regions, score)``, a row for each row of ``docs``.

    ``places``: where a phrase's words stand consecutively (first word, end, label).  ``regions``:
    what the templates accept, the longest from each first word (first word, end, label, mandatory
    words).  Each label found is sure by m / (m + 2), m the most mandatory words that a region or
    phrase of it has; ``score`` is the chance that at least one is right, 0 if none is found.  Null and empty texts have no words; words count from 0; whole texts are read.
    Repeated rows and null ids are kept; other columns are left out; no rows give no rows.
    """
    id_type = dict(docs.dtypes)[id_col]
    wanted = templates() if wanted is None else tuple(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(wanted, phrases)
        place = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("label", pa.string())]))
        region = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("mandatory", pa.int64())]))
        for batch in batches:
            sizes, places, regions, scores = [], [], [], []
            for at in range(0, batch.num_rows, 256):
                for text in batch.column(1).slice(at, 256).to_pylist():
                    n, p, r = scanner.scan(text)
                    most: dict[str, int] = defaultdict(int)
                    for label, m in [(x, b - a) for a, b, x in p] + [(x, m) for _, _, x, m in r]:
                        most[label] = max(most[label], m)
                    sizes.append(n)
                    places.append([{"first": a, "end": b, "label": x} for a, b, x in p])
                    regions.append([{"first": a, "end": b, "label": x, "mandatory": m} for a, b, x, m in r])
                    scores.append(1 - prod(2 / (m + 2) for m in most.values()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(places, place), pa.array(regions, region), pa.array(scores, pa.float64())], ["id", "n_words", "places", "regions", "score"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {id_type}, n_words bigint, places array<struct<first:bigint,end:bigint,label:string>>, regions array<struct<first:bigint,end:bigint,label:string,mandatory:bigint>>, score double"
    )
