"""License scans by template markup, compiled to token automata.

A template is a license text with two kinds of regions: ``[...]`` may be left out, and
``{name:n}`` stands for up to n words of one's own. What is outside must be there word by
word. A template compiles to an automaton over word hashes whose states are places between
tokens; a document is accepted from each place where a reading of the whole template begins.

Every template has a seed, its longest stretch of mandatory words. One pass of array
comparisons finds all seeds and base phrases of a block; automata run around seeds only, over
as many words as the template can span.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from castleflow.llm.common import ALNUM, LOWER, blocks, lean, range_hash, utf8, word_bounds

# Phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Wording of public license notices, with the regions that may vary.
TEMPLATES = {
    "mit": (
        "[this {what:4} is] {verb:1} under the [terms of the] mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software [and to permit persons to whom the software is furnished to do so subject to the following conditions] [the above copyright notice and this permission notice [including the next paragraph] shall be included in all copies or substantial portions of the software] [the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software]",
    ),
    "apache-2.0": (
        "licensed under the apache license version 2 0 [the license]",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license [you may obtain a copy of the license at {where:12}]",
    ),
    "gpl-3.0": (
        "licensed under the gnu general public license [as published by the free software foundation] [either] version 3 [of the license] [or at your option any later version]",
        "redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    ),
    "gpl-2.0": (
        "licensed under the gnu general public license [as published by the free software foundation] [either] version 2 [of the license] [or at your option any later version]",
        "redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    ),
    "cc-by-4.0": ("licensed under [a] [the] [creative commons] [attribution] cc by 4 0 [international] [license]", "licensed under [a] [the] creative commons attribution 4 0 international [license]"),
    "cc-by-nc-4.0": ("licensed under [a] [the] [creative commons] cc by nc 4 0 [international] [license]", "licensed under [a] [the] creative commons attribution noncommercial 4 0 international [license]"),
    "cc-by-sa-4.0": ("licensed under [a] [the] [creative commons] cc by sa 4 0 [international] [license]", "licensed under [a] [the] creative commons attribution sharealike 4 0 international [license]"),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",),
    "bsd-2-clause": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met {mark:1} redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer {mark:1} redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution {mark:1} this software is provided by {holder:12} as is",
    ),
    "bsd-3-clause": (
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution {mark:1} neither the name of {holder:12} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    ),
    "isc": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies [the software is provided as is and {who:4} disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness]",
    ),
    "mpl-2.0": ("this source code form is subject to the terms of the mozilla public license v 2 0 [if a copy of the mpl was not distributed with this file you can obtain one at {where:8}]",),
    "lgpl": ("under the [terms of the] gnu lesser general public license [as published by the free software foundation] [either] version {number:2} [of the license]",),
    "agpl-3.0": ("under the [terms of the] gnu affero general public license [as published by the free software foundation] [either] version 3",),
    "epl-2.0": ("[this program and the accompanying materials are] made available under the terms of the eclipse public license {version:3} which is available at {where:8}",),
    "zlib": (
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software [permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions]",
    ),
    "bsl-1.0": ("permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software",),
    "cc0-1.0": ("to the extent possible under law {who:8} has waived all copyright and related or neighboring rights to this work", "released under [the] [creative commons] cc0 1 0 [universal] [license] [public domain dedication]"),
    "unlicense": (
        "this is free and unencumbered software released into the public domain [anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means]",
    ),
    "proprietary": ("copyright [c] {year:2} {owner:6} all rights reserved",),
}

_TOKEN = re.compile(r"\{\w+:(\d+)\}|\[|\]|[^\s\[\]{}]+")


def _hash(word: str) -> int:
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(range_hash(raw, np.array([0]), np.array([len(raw)]))[0])


@dataclass(frozen=True)
class Template:
    label: str
    markup: str

    @cached_property
    def steps(self) -> tuple[tuple[str, int], ...]:
        """('word', hash), ('any', most words), ('open', index of its close) or ('close', 0)."""
        steps: list[tuple[str, int]] = []
        opens: list[int] = []
        for m in _TOKEN.finditer(self.markup):
            if m[0] == "[":
                opens.append(len(steps))
                steps.append(("open", 0))
            elif m[0] == "]":
                steps[opens.pop()] = ("open", len(steps))
                steps.append(("close", 0))
            elif m[1]:
                steps += [("any", 1)] * int(m[1])
            else:
                steps.append(("word", _hash(m[0])))
        return tuple(steps)

    @cached_property
    def seed(self) -> tuple[int, ...]:
        """Hashes of the longest stretch of words that no region interrupts or holds."""
        best, run, depth = [], [], 0
        for kind, value in [*self.steps, ("any", 1)]:
            depth += (kind == "open") - (kind == "close")
            if kind == "word" and not depth:
                run.append(value)
            else:
                best, run = max(best, run, key=len), []
        return tuple(best)

    @cached_property
    def before(self) -> int:
        """Most words that a reading can hold ahead of its seed."""
        words = [(k, v) for k, v in self.steps if k in ("word", "any")]
        n = len(self.seed)
        at = next(i for i in range(len(words) - n + 1) if tuple(v for k, v in words[i : i + n] if k == "word") == self.seed)
        return at

    def _reach(self, states: set[int]) -> set[int]:
        """All states that regions which are left out lead to."""
        todo = list(states)
        while todo:
            s = todo.pop()
            if s < len(self.steps):
                kind, value = self.steps[s]
                for t in {"open": (s + 1, value + 1), "close": (s + 1,), "any": (s + 1,), "word": ()}[kind]:
                    if t not in states:
                        states.add(t)
                        todo.append(t)
        return states

    def read(self, words: list[int], at: int, end: int) -> int:
        """End of the longest reading of the whole template that begins at word ``at``, or -1."""
        states, found = self._reach({0}), -1
        while True:
            if len(self.steps) in states:
                found = at
            if at >= end or not states:
                return found
            states = self._reach({s + 1 for s in states if s < len(self.steps) and (self.steps[s][0] == "any" or self.steps[s] == ("word", words[at]))})
            at += 1


ALL = tuple(Template(label, markup) for label, texts in TEMPLATES.items() for markup in texts)


def _places(words: np.ndarray, doc_end: np.ndarray, phrase: tuple[int, ...]) -> np.ndarray:
    """Indexes of words from which the phrase stands within one document."""
    at = np.flatnonzero(words == np.uint64(phrase[0]))
    for i, w in enumerate(phrase[1:], 1):
        at = at[at + i < len(words)]
        at = at[words[at + i] == np.uint64(w)]
    return at[at + len(phrase) <= doc_end[at]] if len(at) else at


def scan_block(raw: np.ndarray, offsets: np.ndarray, phrases: dict[str, str], templates: tuple[Template, ...]):
    """(numbers of words, phrase places by document, template spans by document)."""
    raw = LOWER[raw]
    starts, ends, first = word_bounds(raw, offsets, ALNUM)
    words = range_hash(raw, starts, ends)
    doc_end = np.repeat(first[1:], np.diff(first))
    base: dict[int, list[tuple[int, str]]] = {}
    spans: dict[int, list[tuple[int, int, str]]] = {}
    for phrase, label in phrases.items():
        at = _places(words, doc_end, tuple(_hash(w) for w in phrase.split()))
        for i, d in zip(at.tolist(), (np.searchsorted(first, at, "right") - 1).tolist(), strict=True):
            base.setdefault(d, []).append((i - int(first[d]), label))
    seeds: dict[tuple[int, ...], np.ndarray] = {}
    for t in templates:
        if t.seed not in seeds:
            seeds[t.seed] = _places(words, doc_end, t.seed)
        for i in seeds[t.seed].tolist():
            d = int(np.searchsorted(first, i, "right") - 1)
            lo, hi = int(first[d]), int(first[d + 1])
            own = words[max(lo, i - t.before) : min(hi, i + len(t.steps))].tolist()
            shift = max(lo, i - t.before)
            for at in range(shift, i + 1):
                if (end := t.read(own, at - shift, len(own))) >= 0:
                    spans.setdefault(d, []).append((at - lo, end + shift - lo, t.label))
                    break  # the longest of those that hold this seed begins first
    return np.diff(first), base, spans


def _scan(phrases: dict[str, str], templates: tuple[Template, ...], with_spans: bool):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = utf8(batch.column("text"))
            rows: list[tuple] = []
            for a, b in blocks(offs):
                n, base, spans = scan_block(raw[offs[a] : offs[b]], offs[a : b + 1] - offs[a], phrases, templates)
                for d in range(b - a):
                    places, read = base.get(d, ()), spans.get(d, ())
                    own = sorted({label for _, label in places})
                    every = sorted({*own, *(label for *_, label in read)})
                    at = [i for i, _ in places]
                    said = ",".join(f"{label}:{x}:{y}" for x, y, label in sorted(set(read)))
                    rows.append((int(n[d]), len(places), min(at, default=None), max(at, default=None), ",".join(own), ",".join(every), 1.0 if read else 0.5 if places else 0.0, said))
            kinds = [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("readings", pa.string())]
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
            out = {name: pa.array(c, kind) for (name, kind), c in zip(kinds, columns, strict=True) if with_spans or name != "readings"}
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), **out})

    return of


def find_licenses(docs: DataFrame, *, phrases: dict[str, str] = PHRASES, templates: tuple[Template, ...] = ALL, with_spans: bool = True) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and readings, one row for each input row.

    Words are runs of ASCII letters and digits and of anything beyond ASCII, with A-Z
    lower-cased. n_base counts all places of all phrases; first_word and last_word are the
    smallest and largest of them, counted from 0, null without any. labels holds the phrases'
    labels and those of accepted templates; both lists are distinct, sorted and joined by
    commas. score is 1 if a template accepts, 0.5 if only phrases stand, else 0. readings lists
    label:first word:end of the accepted texts. A null text reads as empty; rows that repeat
    are scanned each for itself; extra columns are ignored; an empty table gives an empty result.
    """
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double" + ", readings string" * with_spans
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(lean(_scan(phrases, templates, with_spans)), schema)


def _expression(template: Template) -> str:
    """A template as a regular expression over words that end in a space each."""
    out = []
    for m in _TOKEN.finditer(template.markup):
        out.append("(?:" if m[0] == "[" else ")?" if m[0] == "]" else f"(?:[^ ]+ ){{0,{m[1]}}}" if m[1] else f"{m[0]} ")
    return " " + "".join(out)


def oracle(phrases: dict[str, str] = PHRASES, templates: tuple[Template, ...] = ALL) -> str:
    """DuckDB SQL for find_licenses without the readings, where doc_id is unique."""
    stands = lambda phrase: " AND ".join(f"w[k + {i}] = '{x}'" for i, x in enumerate(phrase.split(), 1))
    places = " UNION ALL ".join(f"SELECT doc_id, k, '{label}' AS label FROM i WHERE {stands(phrase)}" for phrase, label in phrases.items())
    read = " UNION ALL ".join(f"SELECT doc_id, '{t.label}' AS label FROM t WHERE regexp_matches(' ' || array_to_string(w, ' ') || ' ', '{_expression(t)}')" for t in templates)
    listed = "coalesce((SELECT string_agg(label, ',' ORDER BY label) FROM (SELECT DISTINCT label FROM {} x WHERE x.doc_id = t.doc_id)), '')"
    return rf"""
WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT doc_id, w, unnest(range(len(w))) AS k FROM t),
p AS ({places}),
r AS ({read}),
said AS (SELECT doc_id, label FROM p UNION ALL SELECT doc_id, label FROM r)
SELECT t.doc_id, CAST(len(t.w) AS BIGINT) AS n_words, (SELECT count(*) FROM p WHERE p.doc_id = t.doc_id) AS n_base, (SELECT CAST(min(k) AS BIGINT) FROM p WHERE p.doc_id = t.doc_id) AS first_word, (SELECT CAST(max(k) AS BIGINT) FROM p WHERE p.doc_id = t.doc_id) AS last_word,
  {listed.format("p")} AS base_labels, {listed.format("said")} AS labels, CASE WHEN EXISTS (SELECT 1 FROM r WHERE r.doc_id = t.doc_id) THEN 1.0 WHEN EXISTS (SELECT 1 FROM p WHERE p.doc_id = t.doc_id) THEN 0.5 ELSE 0.0 END::DOUBLE AS score FROM t
"""
