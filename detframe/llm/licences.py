"""Licence scan: a generalised suffix automaton over the words of licence notices reads every text as a stream.

After each word the automaton knows the longest run of words ending there that stands somewhere in a notice (matching
statistics). Runs of ``MIN_RUN`` words or more are chained, in the order of the notice, into spans; a notice whose words are
covered to ``MIN_COVER`` or more gives its label. Phrases are short notices of which every place is reported.

Defined cases: null or wordless texts give no places, no labels and score 0; equal texts give equal rows; a text of any length
is read in one pass with memory for its words; further columns are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from detframe.llm.common import byte_texts, column, rows

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
MIN_RUN, MAX_GAP, MIN_COVER = 4, 40, 0.5

# Phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Wording of public licence notices.
NOTICES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. "
    "You may obtain a copy of the License at",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
    "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
    "provided that the above copyright notice and this permission notice appear in all copies",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
    "(the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
    "publish, distribute, sublicense, and/or sell copies of the Software",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "unlicense": "This is free and unencumbered software released into the public domain",
}


def words_of(text: bytes) -> list[bytes]:
    """Lower-case words; only A-Z change."""
    return WORD.findall(text.lower())


@dataclass
class Automaton:
    """All runs of words of all notices: each state is a set of runs that end at the same places."""

    phrases: dict[str, str] = field(default_factory=lambda: dict(PHRASES))
    notices: dict[str, str] = field(default_factory=lambda: dict(NOTICES))

    def __post_init__(self):
        self.names = sorted(self.notices)
        self.next: list[dict[int, int]] = [{}]
        self.link, self.longest = [-1], [0]
        self.places: list[dict[int, int]] = [{}]  # notice -> where its first such run ends
        self.vocabulary: dict[bytes, int] = {}
        self.sizes = []
        phrase_states = []
        for k, name in enumerate(self.names):
            words = words_of(self.notices[name].encode())
            self.sizes.append(len(words))
            self._add(words, k)
        for phrase, label in self.phrases.items():
            words = words_of(phrase.encode())
            phrase_states.append((self._add(words, None), len(words), label))
        order = sorted(range(1, len(self.next)), key=lambda s: -self.longest[s])
        for s in order:  # a shorter run ends wherever a longer one does
            for k, end in self.places[s].items():
                above = self.places[self.link[s]]
                above[k] = min(end, above.get(k, end))
        self.ends: list[list[tuple[int, str]]] = [[] for _ in self.next]
        own: dict[int, list[tuple[int, str]]] = {}
        for s, size, label in phrase_states:
            own.setdefault(s, []).append((size, label))
        for s in reversed(order):
            self.ends[s] = own.get(s, []) + self.ends[self.link[s]]

    def _add(self, words: list[bytes], notice: int | None) -> int:
        last = 0
        for end, word in enumerate(words):
            last = self._extend(last, self.vocabulary.setdefault(word, len(self.vocabulary)))
            if notice is not None:
                self.places[last].setdefault(notice, end + 1)
        return last

    def _new(self, longest: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.longest.append(longest)
        self.places.append({})
        return len(self.next) - 1

    def _clone(self, p: int, c: int) -> int:
        """A state for the runs through ``p`` alone, split off from the state that ``c`` leads to."""
        q = self.next[p][c]
        clone = self._new(self.longest[p] + 1)
        self.next[clone], self.link[clone] = dict(self.next[q]), self.link[q]
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            q = self.next[last][c]
            return q if self.longest[q] == self.longest[last] + 1 else self._clone(last, c)
        state, p = self._new(self.longest[last] + 1), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = state
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[state] = q if self.longest[q] == self.longest[p] + 1 else self._clone(p, c)
        return state

    def statistics(self, words: list[bytes]) -> tuple[list[tuple[int, int, int]], list[tuple[int, str]]]:
        """Runs that can't be made longer to the right, as (first word, length, state), and places of phrases (first word, label)."""
        step, link, longest, ends = self.next, self.link, self.longest, self.ends
        runs, found, state, length = [], [], 0, 0
        for i, c in enumerate(map(self.vocabulary.get, words)):
            if c is None:
                if length >= MIN_RUN:
                    runs.append((i - length, length, state))
                state = length = 0
                continue
            if c not in step[state]:
                if length >= MIN_RUN:
                    runs.append((i - length, length, state))
                while state >= 0 and c not in step[state]:
                    state = link[state]
                if state < 0:
                    state = length = 0
                    continue
                length = longest[state]
            state = step[state][c]
            length += 1
            for size, label in ends[state]:
                if size <= length:
                    found.append((i - size + 1, label))
        if length >= MIN_RUN:
            runs.append((len(words) - length, length, state))
        return runs, found

    def spans(self, runs: list[tuple[int, int, int]]) -> list[tuple[str, int, int, float]]:
        """Best span of each notice: (label, first word, words, covered share), runs chained in the order of the notice."""
        best: dict[int, tuple[float, int, int]] = {}
        opened: dict[int, tuple[int, int, int, int]] = {}  # notice -> first word, last word, notice words behind, covered
        for start, length, state in runs:
            for k, end in self.places[state].items():
                begin = end - length
                first, last, behind, covered = opened.get(k, (start, start, 0, 0))
                if covered and (start - last > MAX_GAP or end <= behind):
                    first, behind, covered = start, 0, 0
                covered += end - max(begin, behind)
                opened[k] = (first, start + length, end, covered)
                best[k] = max(best.get(k, (0.0, 0, 0)), (covered / self.sizes[k], -first, start + length - first))
        return [(self.names[k], -first, size, share) for k, (share, first, size) in sorted(best.items())]

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, str]], list[tuple[str, int, int, float]]]:
        """Number of words, places of phrases, best spans."""
        words = words_of(text)
        runs, found = self.statistics(words)
        return len(words), found, self.spans(runs)


SCAN = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("places", pa.list_(pa.struct([("first", pa.int64()), ("label", pa.string())]))),
    ("spans", pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("words", pa.int64()), ("covered", pa.float64())]))),
])
SCAN_SQL = (
    "doc_id long, n_words long, places array<struct<first: long, label: string>>, "
    "spans array<struct<label: string, first: long, words: long, covered: double>>"
)


def scan(docs: DataFrame, automaton: Automaton | None = None) -> DataFrame:
    """One row per document: words, places of phrases in order, and the best span of each notice met. No shuffle."""
    own = automaton or Automaton()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [own.scan(x) for x in byte_texts(column(batch, "text"))]
            yield rows(
                SCAN, doc_id=column(batch, "doc_id").to_pylist(), n_words=[x[0] for x in found],
                places=[[{"first": a, "label": b} for a, b in x[1]] for x in found],
                spans=[[dict(zip(("label", "first", "words", "covered"), s)) for s in x[2]] for x in found],
            )

    return docs.select("doc_id", "text").mapInArrow(run, SCAN_SQL)
