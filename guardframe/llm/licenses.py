"""Licence statements in texts by a generalised suffix automaton of licence templates.

All templates are one automaton over word numbers. A text streams through it and every word gets
its matching statistic, the longest run of words ending there that stands in some template. Long
matches that cannot be extended are chained in order of text and template; a chain that covers
enough of a template is a span with its label.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Licence statements and their labels, in common wordings.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License. You may obtain a copy of the License at"),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is "
                   "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or "
                   "implied."),
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial "
            "portions of the Software."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
            "that the following conditions are met"),
    ("gpl-notice", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                   "General Public License as published by the Free Software Foundation"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-4.0", "Licensed under CC BY 4.0"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related rights to this work"),
]
PHRASES = [("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved")]

#: Least words of a match, most words between matches of a chain, least covered share of a template.
LEAST, GAP, COVER = 3, 8, 0.75

_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32
               for c in range(256))


def words(text: str | None) -> list[bytes]:
    """The words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` with A-Z lower-cased; none for null."""
    return [] if text is None else text.encode().translate(_WORDS).split()


class Automaton:
    """The substrings of several sequences, with where each of them ends."""

    def __init__(self, sequences: list[list[int]]):
        self.step: list[dict[int, int]] = [{}]
        self.size, self.link = [0], [-1]
        self.ends: list[set[tuple[int, int]]] = [set()]
        for k, sequence in enumerate(sequences):
            last = 0
            for at, word in enumerate(sequence):
                last = self._extend(last, word)
                self.ends[last].add((k, at + 1))
        for state in sorted(range(1, len(self.size)), key=self.size.__getitem__, reverse=True):
            if self.link[state] > 0:
                self.ends[self.link[state]] |= self.ends[state]

    def _state(self, size: int, step: dict[int, int], link: int) -> int:
        self.size.append(size)
        self.step.append(step)
        self.link.append(link)
        self.ends.append(set())
        return len(self.size) - 1

    def _split(self, before: int, word: int) -> int:
        """The state behind ``before`` on ``word``, made to hold nothing longer than through it."""
        after = self.step[before][word]
        if self.size[after] == self.size[before] + 1:
            return after
        copy = self._state(self.size[before] + 1, dict(self.step[after]), self.link[after])
        self.link[after] = copy
        while before >= 0 and self.step[before].get(word) == after:
            self.step[before][word] = copy
            before = self.link[before]
        return copy

    def _extend(self, last: int, word: int) -> int:
        if word in self.step[last]:
            return self._split(last, word)
        new = self._state(self.size[last] + 1, {}, 0)
        at = last
        while at >= 0 and word not in self.step[at]:
            self.step[at][word] = new
            at = self.link[at]
        if at >= 0:
            self.link[new] = self._split(at, word)
        return new

    def statistics(self, sequence: Iterable[int]) -> Iterator[tuple[int, int]]:
        """For every word, the length and the state of the longest match that ends there."""
        state = size = 0
        for word in sequence:
            while state and word not in self.step[state]:
                state = self.link[state]
                size = self.size[state]
            if word in self.step[state]:
                state, size = self.step[state][word], size + 1
            yield size, state


class Scanner:
    """Phrases and template spans of texts."""

    def __init__(self, templates: list[tuple[str, str]], phrases: list[tuple[str, str]], least: int = LEAST,
                 gap: int = GAP, cover: float = COVER):
        own = [(label, words(text)) for label, text in templates]
        said = [(label, words(text)) for label, text in phrases]
        every = sorted({w for _, found in own + said for w in found})
        self.number = {w: k + 1 for k, w in enumerate(every)}
        self.labels = [label for label, _ in own]
        self.lengths = [len(found) for _, found in own]
        self.automaton = Automaton([[self.number[w] for w in found] for _, found in own])
        self.phrases = [(label, [self.number[w] for w in found]) for label, found in said if found]
        self.least, self.gap, self.cover = least, gap, cover

    def scan(self, text: str | None) -> tuple[int, list[tuple[str, int]], list[tuple[str, int, int, float]]]:
        """Number of words, (label, word) of phrases, and (label, first, last, covered share) of spans."""
        found = words(text)
        numbers = np.fromiter(map(self.number.get, found, repeat(0)), np.int64, len(found))
        places = []
        for label, phrase in self.phrases:
            n = len(numbers) - len(phrase) + 1
            if n > 0:
                hit = numbers[:n] == phrase[0]
                for k, word in enumerate(phrase[1:], 1):
                    hit &= numbers[k:k + n] == word
                places += [(label, int(at)) for at in np.flatnonzero(hit)]
        return len(found), sorted(places, key=lambda p: (p[1], p[0])), self._spans(numbers)

    def _spans(self, numbers: np.ndarray) -> list[tuple[str, int, int, float]]:
        known = np.flatnonzero(np.diff(np.r_[0, numbers > 0, 0]))
        matches: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for first, last in zip(known[::2].tolist(), known[1::2].tolist()):
            if last - first < self.least:
                continue
            before = (0, 0)
            for at, now in enumerate([*self.automaton.statistics(numbers[first:last].tolist()), (0, 0)], first):
                size, state = before
                if size >= self.least and now[0] != size + 1:
                    for template, end in self.automaton.ends[state]:
                        matches[template].append((at - size, end - size, size))
                before = now
        spans = []
        for template, own in matches.items():
            spans += self._chains(template, sorted(own))
        return sorted(set(spans), key=lambda s: (s[1], s[2], s[0], s[3]))

    def _chains(self, template: int, matches: list[tuple[int, int, int]]) -> Iterator[tuple[str, int, int, float]]:
        """The best chain of every cluster of matches; a match follows others that end shortly before it."""
        best: list[tuple[int, int]] = []  # covered words and start of the best chain that ends here
        low = 0
        for k, (at, place, size) in enumerate(matches):
            covered, start = size, at
            longest = self.lengths[template]
            while low < k and matches[low][0] + longest + self.gap < at:
                low += 1
            for j in range(low, k):
                a, p, n = matches[j]
                over = max(0, a + n - at, p + n - place)
                if p < place and a < at and over < size and at - a - n <= self.gap and place - p - n <= self.gap:
                    if best[j][0] + size - over > covered:
                        covered, start = best[j][0] + size - over, best[j][1]
            best.append((covered, start))
        kept: dict[int, tuple[int, int]] = {}
        for (at, _, size), (covered, start) in zip(matches, best):
            if covered > kept.get(start, (0, 0))[0]:
                kept[start] = (covered, at + size - 1)
        for start, (covered, last) in kept.items():
            share = min(1.0, covered / self.lengths[template])
            if share >= self.cover:
                yield self.labels[template], start, last, share


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
         templates: list[tuple[str, str]] = TEMPLATES, phrases: list[tuple[str, str]] = PHRASES, least: int = LEAST,
         gap: int = GAP, cover: float = COVER) -> DataFrame:
    """One row (id, n_words, places, spans) per document, from its whole text.

    ``places`` are (label, word) of the phrases; ``spans`` are (label, first, last, covered) of the
    chains that cover at least ``cover`` of a template. Words count from 0. Null is empty; empty
    texts have no words. Rows without id or with repeated ids are kept; further columns are ignored.
    """
    place = pa.struct([("label", pa.string()), ("word", pa.int64())])
    span = pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("covered", pa.float64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, phrases, least, gap, cover)
        for batch in batches:
            found = [scanner.scan(text.as_py()) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([f[0] for f in found], pa.int64()),
                pa.array([[dict(zip(("label", "word"), p)) for p in f[1]] for f in found], pa.list_(place)),
                pa.array([[dict(zip(("label", "first", "last", "covered"), s)) for s in f[2]] for f in found],
                         pa.list_(span))], names=["id", "n_words", "places", "spans"])
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, "id long, n_words long, places array<struct<label:string,word:long>>,"
             " spans array<struct<label:string,first:long,last:long,covered:double>>")
