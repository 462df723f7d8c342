"""Licence scan: matching statistics of texts against a generalised suffix automaton of licence templates.

The automaton is built over the words of all templates and phrases. A text is streamed through it; at each
word it tells the longest stretch of words that ends there and stands in a template. Stretches of MIN_MATCH
words that can't go on to the right are chained, template by template, where they stand in the same order and
near one another; a chain that covers SHARE of its template is a span. Of spans that overlap in the text, the
one that covers more words stays. A phrase is found wherever its words end a match, by the automaton's links.

Words are runs of ASCII letters and digits and of all signs beyond ASCII, A-Z folded. Only stretches whose
neighbouring words stand side by side in some template are streamed; elsewhere matches are one word long at
most. Nothing is shuffled, and each text is scanned on its own: cost is in proportion to its length.

Defined results: null and empty texts have no words, no labels and score 0; repeated rows and null ids give a
row each; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docaudit.llm.bytewords import blocks, bytes_of, words
from docaudit.llm.common import small_batches

#: Words of a match that a chain is made of (a shorter template must match as a whole).
MIN_MATCH = 3
#: Words of the text, and of the template, that may lie between two matches of a chain.
GAP = 12
#: Share of a template's words that a span covers.
SHARE = 0.75

# Phrases (label, words) of the base labels.
PHRASES = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))
# Public licence notices (label, text).
TEMPLATES = (
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use,
        copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
        Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall
        be included in all copies or substantial portions of the Software."""),
    ("apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
        the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law
        or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
        CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and
        limitations under the License."""),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("mit", "Released under the MIT License"),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3"),
    ("gpl-2.0", "licensed under the GNU General Public License, version 2"),
    ("gpl-or-later", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
        This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
        MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."""),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the
        following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
        following disclaimer in the documentation and/or other materials provided with the distribution."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
        provided that the above copyright notice and this permission notice appear in all copies."""),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("cc-by-4.0", "Licensed under CC BY 4.0"),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("all-rights-reserved", "All rights reserved"),
)

_PLAIN = np.full(256, 32, np.uint8)
_PLAIN[128:] = np.arange(128, 256)
_PLAIN[48:58] = np.arange(48, 58)
_PLAIN[97:123] = np.arange(97, 123)
_PLAIN[65:91] = np.arange(97, 123)


def plain(texts: pa.Array) -> pa.Array:
    """The texts with A-Z folded and each ASCII sign that is no letter or digit as a space."""
    buf, offsets = bytes_of(texts)
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(_PLAIN[buf]))


@dataclass
class Automaton:
    """Suffix automaton of several word sequences; state 0 is the start."""

    step: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    size: list[int] = field(default_factory=lambda: [0])
    own: list[list[tuple[int, int]]] = field(default_factory=lambda: [[]])  # (sequence, end) that a state was made or met for

    def _new(self, size: int, step: dict[int, int], link: int) -> int:
        self.step.append(step)
        self.link.append(link)
        self.size.append(size)
        self.own.append([])
        return len(self.size) - 1

    def _split(self, p: int, word: int) -> int:
        """The state that word leads to from p, cut so that its longest string is one word longer than p's."""
        q = self.step[p][word]
        if self.size[q] == self.size[p] + 1:
            return q
        twin = self._new(self.size[p] + 1, dict(self.step[q]), self.link[q])
        self.link[q] = twin
        while p >= 0 and self.step[p].get(word) == q:
            self.step[p][word] = twin
            p = self.link[p]
        return twin

    def add(self, number: int, sequence: list[int]) -> None:
        last = 0
        for end, word in enumerate(sequence, 1):
            if word in self.step[last]:
                last = self._split(last, word)
            else:
                new, p = self._new(self.size[last] + 1, {}, 0), last
                while p >= 0 and word not in self.step[p]:
                    self.step[p][word] = new
                    p = self.link[p]
                if p >= 0:
                    self.link[new] = self._split(p, word)
                last = new
            self.own[last].append((number, end))

    def match(self, sequence: list[int]) -> Iterator[tuple[int, int]]:
        """For each word: length of the longest match that ends there, and its state."""
        at, n = 0, 0
        step, link, size = self.step, self.link, self.size
        for word in sequence:
            while at and word not in step[at]:
                at = link[at]
                n = size[at]
            if word in step[at]:
                at, n = step[at][word], n + 1
            yield n, at

    @cached_property
    def below(self) -> list[list[int]]:
        """States by the state that they link to."""
        out: list[list[int]] = [[] for _ in self.link]
        for v, u in enumerate(self.link):
            if u >= 0:
                out[u].append(v)
        return out

    @cached_property
    def _ends(self) -> dict[int, list[tuple[int, int]]]:
        return {}

    def ends(self, state: int) -> list[tuple[int, int]]:
        """(sequence, end) of each place where the state's strings stand."""
        if state not in self._ends:
            out, todo = [], [state]
            while todo:
                v = todo.pop()
                out += self.own[v]
                todo += self.below[v]
            self._ends[state] = out
        return self._ends[state]


class Scanner:
    """Templates and phrases as an automaton over the ids of their words."""

    def __init__(self, templates=TEMPLATES, phrases=PHRASES):
        self.labels = [label for label, _ in templates]
        self.phrases = [label for label, _ in phrases]
        w = words(plain(pa.array([t for _, t in [*templates, *phrases]], pa.large_string())))
        self.vocabulary, ids = np.unique(w.hash, return_inverse=True)
        sequences = [ids[w.first[k] : w.first[k + 1]].tolist() for k in range(len(w.first) - 1)]
        self.sizes = [len(s) for s in sequences[: len(templates)]]
        self.least = min([MIN_MATCH, *self.sizes])
        self.automaton = Automaton()
        for k, s in enumerate(sequences):
            self.automaton.add(k, s)
        self.width = len(self.vocabulary)
        self.pairs = np.unique(np.array([a * self.width + b for s in sequences for a, b in zip(s, s[1:], strict=False)] or [-1], np.int64))
        # phrases by the state where a match must be or come from, and the words that it needs
        self.heads: dict[int, list[tuple[int, int]]] = {}
        for k, s in enumerate(sequences[len(templates) :]):
            at = 0
            for word in s:
                at = self.automaton.step[at][word]
            if s:
                self.heads.setdefault(at, []).append((k, len(s)))
        self.one_word = any(len(s) == 1 for s in sequences)

    @cached_property
    def _phrases(self) -> dict[int, list[tuple[int, int]]]:
        return {}

    def phrases_at(self, state: int) -> list[tuple[int, int]]:
        """(phrase, words) of the phrases that stand at the end of a state's strings."""
        if state not in self._phrases:
            out, v = [], state
            while v > 0:
                out += self.heads.get(v, [])
                v = self.automaton.link[v]
            self._phrases[state] = out
        return self._phrases[state]

    def runs(self, ids: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int]]:
        """Stretches (from, to) of words in one document, each beside a word that it stands beside in a template."""
        known = ids >= 0
        key = ids[:-1] * self.width + ids[1:]
        near = known[:-1] & known[1:]
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        near &= self.pairs[at] == key
        starts = first[1:-1]
        near[starts[(starts > 0) & (starts < len(ids))] - 1] = False
        edge = np.diff(np.concatenate(([0], near.view(np.int8), [0])))
        yield from zip(np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) + 1).tolist(), strict=True)
        if self.one_word:
            beside = np.zeros(len(ids), bool)
            beside[:-1] |= near
            beside[1:] |= near
            for k in np.flatnonzero(known & ~beside).tolist():
                yield k, k + 1

    def scan(self, texts: pa.Array) -> Iterator[tuple[int, list[dict], list[dict]]]:
        """For each text: number of words, phrases found, template chains (all, in no order)."""
        w = words(plain(texts))
        ids = np.searchsorted(self.vocabulary, w.hash)
        ids[ids == self.width] = 0
        ids = np.where(self.vocabulary[ids] == w.hash, ids, -1) if len(ids) else ids
        found: dict[int, tuple[list[dict], dict[int, list[tuple[int, int, int]]]]] = {}
        for a, b in self.runs(ids, w.first) if len(ids) else ():
            doc = int(np.searchsorted(w.first, a, side="right")) - 1
            base, anchors = found.setdefault(doc, ([], {}))
            self._run(ids[a:b].tolist(), a - int(w.first[doc]), base, anchors)
        for doc, n in enumerate(np.diff(w.first).tolist()):
            base, anchors = found.get(doc, ([], {}))
            yield n, base, [c for k in sorted(anchors) for c in self.chains(k, anchors[k])]

    def _run(self, ids: list[int], at: int, base: list[dict], anchors: dict[int, list[tuple[int, int, int]]]) -> None:
        stats = [*self.automaton.match(ids), (0, 0)]
        for i, (n, state) in enumerate(stats[:-1]):
            for k, size in self.phrases_at(state):
                if size <= n:
                    base.append({"label": self.phrases[k], "word": at + i + 1 - size})
            if stats[i + 1][0] != n + 1:  # the match can't go on
                self._anchors(n, state, at + i + 1, anchors)

    def _anchors(self, n: int, state: int, end: int, anchors: dict[int, list[tuple[int, int, int]]]) -> None:
        """The match, and its suffixes that stand at further places, as (end in the text, end in the template, words)."""
        seen: set[tuple[int, int]] = set()
        while state > 0 and n >= self.least:
            for k, t_end in self.automaton.ends(state):
                if k < len(self.sizes) and (k, t_end) not in seen and n >= min(MIN_MATCH, self.sizes[k]):
                    seen.add((k, t_end))
                    anchors.setdefault(k, []).append((end, t_end, n))
            state = self.automaton.link[state]
            n = self.automaton.size[state]

    def chains(self, k: int, anchors: list[tuple[int, int, int]]) -> list[dict]:
        """Best chains of a template's matches, at most one for each end that no longer chain passes through."""
        best: list[tuple[int, int, int]] = []  # covered words, first word, anchor before
        passed = [False] * len(anchors)
        anchors.sort()
        for j, (end, t_end, n) in enumerate(anchors):
            cover, start, before = n, end - n, -1
            for i in range(j - 1, -1, -1):
                end_i, t_end_i, n_i = anchors[i]
                if end_i < end - n - GAP:
                    break
                gap = (end - n) - end_i, (t_end - n) - t_end_i
                if end_i < end and t_end_i < t_end and end_i - n_i < end - n and t_end_i - n_i < t_end - n and max(gap) <= GAP:
                    c = best[i][0] + n + min(0, *gap)
                    if c > cover:
                        cover, start, before = c, best[i][1], i
            best.append((cover, start, before))
            if before >= 0:
                passed[before] = True
        size = self.sizes[k]
        return [
            {"label": self.labels[k], "template": k, "first_word": s, "last_word": anchors[j][0] - 1, "covered": c, "share": min(1.0, c / size)}
            for j, (c, s, _) in enumerate(best) if not passed[j]
        ]


def spans_of(chains: list[dict], share: float = SHARE) -> list[dict]:
    """Chains of enough of their template; of those that overlap in the text, the one that covers more stays
    (ties: the larger share, then the earlier in the text, then the earlier template)."""
    kept: list[dict] = []
    ends: list[tuple[int, int]] = []
    for c in sorted((c for c in chains if c["share"] >= share), key=lambda c: (-c["covered"], -c["share"], c["first_word"], c["template"])):
        at = bisect_left(ends, (c["first_word"], -1))
        if (at == 0 or ends[at - 1][1] < c["first_word"]) and (at == len(ends) or ends[at][0] > c["last_word"]):
            ends.insert(at, (c["first_word"], c["last_word"]))
            kept.append(c)
    return sorted(kept, key=lambda c: c["first_word"])


@lru_cache(maxsize=4)
def scanner(templates=TEMPLATES, phrases=PHRASES) -> Scanner:
    return Scanner(templates, phrases)


_PHRASE = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))
_SPAN = pa.list_(pa.struct([("label", pa.string()), ("template", pa.int32()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("covered", pa.int64()), ("share", pa.float64())]))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, phrases=PHRASES) -> DataFrame:
    """doc_id, n_words, phrases (array of label and first word, in order), spans (array of label, template's number,
    first_word, last_word, covered words, share of the template), best (the largest share of any chain). templates
    and phrases are tuples of (label, text) and go to each worker: they are the licences, not the corpus."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = (
        f"doc_id {kind}, n_words long, phrases array<struct<label:string,word:long>>, "
        "spans array<struct<label:string,template:int,first_word:long,last_word:long,covered:long,share:double>>, best double"
    )

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = scanner(templates, phrases)
        for batch in batches:
            for part in blocks(batch, "text"):
                n, base, spans, best = [], [], [], []
                for count, found, chains in machine.scan(part.column("text")):
                    n.append(count)
                    base.append(sorted(found, key=lambda x: (x["word"], x["label"])))
                    spans.append(spans_of(chains))
                    best.append(max((c["share"] for c in chains), default=0.0))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(base, _PHRASE), pa.array(spans, _SPAN), pa.array(best, pa.float64())],
                    ["doc_id", "n_words", "phrases", "spans", "best"],
                )

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(scanned, schema)


def licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, phrases=PHRASES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score: 1 where a phrase stands, else
    the largest share of a template that a chain covers. labels holds the phrases' and the spans'."""
    x = scan(docs, id_col, text_col, templates, phrases)
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return x.select(
        "doc_id", "n_words", F.size("phrases").cast("long").alias("n_base"),
        F.array_min("phrases.word").alias("first_word"), F.array_max("phrases.word").alias("last_word"),
        joined(F.col("phrases.label")).alias("base_labels"), joined(F.concat("phrases.label", "spans.label")).alias("labels"),
        F.when(F.size("phrases") > 0, 1.0).otherwise(F.col("best")).alias("score"), F.size("spans").cast("long").alias("n_spans"),
    )


def licence_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, phrases=PHRASES) -> DataFrame:
    """A row for each span: doc_id, label, template, first_word, last_word, covered, share."""
    return scan(docs, id_col, text_col, templates, phrases).select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.*")
