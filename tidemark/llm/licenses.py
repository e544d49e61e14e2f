"""Licence scans by a generalised suffix automaton of licence tokens.

All templates stand in one automaton over words. Every text streams through it
once; the matching statistics are the longest template stretch that ends at each
word. Stretches that can't grow are anchors, and anchors of one template that stand
in order are chained to a span. The share of the template that a chain covers
decides whether its label is given.
"""

import pyarrow as pa
from pyspark.sql import types as T

from .common import slices, texts, words

# Phrases whose every place counts, and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Well-known notices and openings of public licences.
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache-2", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("gpl-3", "licensed under the GNU General Public License, version 3"),
    ("gpl-3", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl-2", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
]

SHORTEST = 4
GAP = 12
COVER = 0.75

SCANNED = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_base", T.LongType()),
    T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()),
    T.StructField("base_labels", T.StringType()), T.StructField("labels", T.StringType()), T.StructField("score", T.DoubleType()),
    T.StructField("spans", T.ArrayType(T.StructType([
        T.StructField("label", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
        T.StructField("cover", T.DoubleType()),
    ]))),
])
_SPANS = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("cover", pa.float64())]))


class Automaton:
    """Generalised suffix automaton of word sequences, with the places of each state in the templates."""

    def __init__(self, templates=TEMPLATES, base=BASE):
        self.next, self.link, self.length = [{}], [-1], [0]
        self.labels = [label for label, _ in templates]
        sequences = [words(text) for _, text in templates]
        self.sizes = [len(s) for s in sequences]
        self.places = [{}]
        ends = {}
        for number, sequence in enumerate(sequences):
            state = 0
            for at, word in enumerate(sequence):
                state = self._extend(state, word)
                self.places[state].setdefault(number, at + 1)
        for phrase, label in base.items():
            state = 0
            for word in words(phrase):
                state = self._extend(state, word)
            ends.setdefault(state, []).append((len(words(phrase)), label))
        # From long to short: a state's places are those of all that end with it.
        order = sorted(range(1, len(self.next)), key=lambda s: -self.length[s])
        for s in order:
            for number, at in self.places[s].items():
                up = self.places[self.link[s]]
                up[number] = min(at, up.get(number, at))
        # The phrases that a state ends with, of its own or its shorter suffixes.
        self.phrases = [()] * len(self.next)
        for s in reversed(order):
            self.phrases[s] = tuple(ends.get(s, ())) + self.phrases[self.link[s]]
        self.vocabulary = {w for n in self.next for w in n}

    def _state(self, length):
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        self.places.append({})
        return len(self.next) - 1

    def _split(self, p, word, q):
        """Part off the strings of q that are just one word longer than p's."""
        copy = self._state(self.length[p] + 1)
        self.next[copy], self.link[copy] = dict(self.next[q]), self.link[q]
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def _extend(self, last, word):
        q = self.next[last].get(word)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, word, q)
        new, p = self._state(self.length[last] + 1), last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
        return new

    def stream(self, sequence, shortest=SHORTEST):
        """Places of base phrases, and anchors (end, length, state) that can't grow, of one text."""
        follow, link, size, phrases, known = self.next, self.link, self.length, self.phrases, self.vocabulary
        base, anchors, state, run = [], [], 0, 0
        for at, word in enumerate(sequence):
            if word not in known:
                if run >= shortest:
                    anchors.append((at, run, state))
                state = run = 0
                continue
            if word not in follow[state]:
                if run >= shortest:
                    anchors.append((at, run, state))
                while state and word not in follow[state]:
                    state = link[state]
                run = size[state]
            if word in follow[state]:
                state = follow[state][word]
                run += 1
                if phrases[state]:
                    base += [(at + 1 - n, label) for n, label in phrases[state] if n <= run]
        if run >= shortest:
            anchors.append((len(sequence), run, state))
        return base, anchors

    def chain(self, anchors, gap=GAP):
        """Spans (label, start, end, covered share) of anchors that stand in a template's order."""
        by = {}
        for end, run, state in anchors:
            for number, at in self.places[state].items():
                by.setdefault(number, []).append((end - run, end, at - run, at))
        out = []
        for number, found in by.items():
            chains = []
            for start, end, low, high in found:
                last = chains[-1] if chains else None
                if last and start - last[1] <= gap and low + max(0, last[1] - start) >= last[3]:
                    new = high - max(low, last[3])
                    chains[-1] = (last[0], end, last[2] + max(0, new), max(high, last[3]))
                else:
                    chains.append((start, end, high - low, high))
            out += [(self.labels[number], a, b, min(1.0, n / self.sizes[number])) for a, b, n, _ in chains]
        return out


def scan(docs, id_col="doc_id", text_col="text", templates=TEMPLATES, base=BASE, shortest=SHORTEST, gap=GAP, cover=COVER):
    """Base places, labels, score and covered spans of every row.

    A template's label is given where a chain covers ``cover`` of its words; base
    labels always stay. The score is 1 with a base phrase and else the best share
    that a chain covers. Null and empty texts have no words, no labels and score 0;
    repeated rows are scanned one by one; ids may be null. Templates are a fixed,
    small list and are sent to all tasks.
    """
    sent = docs.sparkSession.sparkContext.broadcast(Automaton(templates, base))

    def run(batches):
        automaton = sent.value
        for batch in batches:
            for piece in slices(batch):
                rows = []
                for doc, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist()):
                    sequence = words(text)
                    found, anchors = automaton.stream(sequence, shortest)
                    spans = automaton.chain(anchors, gap) if anchors else []
                    best = max([float(bool(found)), *(s[3] for s in spans)])
                    spans = [s for s in spans if s[3] >= cover]
                    first = {label for _, label in found}
                    rows.append((
                        doc, len(sequence), len(found), min((a for a, _ in found), default=None), max((a for a, _ in found), default=None),
                        ",".join(sorted(first)), ",".join(sorted(first | {s[0] for s in spans})), best,
                        [dict(zip(("label", "start", "end", "cover"), s)) for s in sorted(spans, key=lambda s: s[1:])],
                    ))
                kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64(), _SPANS]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=SCANNED.names)

    return texts(docs, id_col, text_col).mapInArrow(run, SCANNED)
