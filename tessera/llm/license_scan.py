"""Licence scan with a generalised suffix automaton of licence words.

The automaton holds every substring of every template.  A document is streamed
through it word by word, which yields its matching statistics: for each place
the longest suffix that is a substring of some template.  Maximal matches of at
least ``MIN_MATCH`` words are mapped to template places and chained in order
with bounded gaps; a chain that covers enough of its template is a span with the
template's label.  Base phrases are templates too; the automaton's states know
which phrases end in them, so every place of a phrase is found in the same pass.

One map pass, no shuffle.  The automaton grows with the templates only and goes
to the tasks with the function.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import text_rows
from tessera.llm.grams import releasing, texts_of

# Base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Notices and openings of public licences: (label, text).
TEMPLATES = [
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
            "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
            "copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the "
                   "License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
            "General Public License as published by the Free Software Foundation"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-4.0", "Licensed under CC BY 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
            "that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]

MIN_MATCH = 3
MAX_GAP = 8
COVERAGE = 0.8

# A-Z to lower case; every other byte that belongs to no word to a blank.
_WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_WORD_BYTES).split()


class Automaton:
    """Generalised suffix automaton over word ids, with the places of each state in the templates."""

    def __init__(self, sequences: list[list[bytes]], phrases: list[list[bytes]]):
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.places: list[set[tuple[int, int]]] = [set()]  # (template, end)
        for t, seq in enumerate([*sequences, *phrases]):
            last = 0
            for end, word in enumerate(seq):
                last = self._extend(last, self.vocab.setdefault(word, len(self.vocab)))
                if t < len(sequences):
                    self.places[last].add((t, end))
        by_length = sorted(range(1, len(self.next)), key=self.length.__getitem__)
        for s in reversed(by_length):
            self.places[self.link[s]] |= self.places[s]
        self.places[0] = set()
        own: list[list[int]] = [[] for _ in self.next]
        for p, seq in enumerate(phrases):
            s = 0
            for word in seq:
                s = self.next[s][self.vocab[word]]
            own[s].append(p)
        self.ends: list[list[int]] = [[] for _ in self.next]  # phrases that are suffixes of the state
        for s in by_length:
            self.ends[s] = own[s] + self.ends[self.link[s]]

    def _new(self, length: int, nxt: dict[int, int], link: int) -> int:
        self.next.append(nxt)
        self.link.append(link)
        self.length.append(length)
        self.places.append(set())
        return len(self.next) - 1

    def _split(self, p: int, w: int) -> int:
        """The state of p's string extended by w, split off where it shares a state with longer strings."""
        q = self.next[p][w]
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._new(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:
            return self._split(last, w)
        cur = self._new(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = cur
            p = self.link[p]
        if p >= 0:
            self.link[cur] = self._split(p, w)
        return cur

    def stream(self, words: list[bytes], least: int):
        """(phrase ends as (phrase, end), maximal matches of at least ``least`` words as (end, length, state))."""
        found, matches = [], []
        get, nxt, link, length, ends = self.vocab.get, self.next, self.link, self.length, self.ends
        s = n = 0
        for i, w in enumerate(map(get, words)):
            if w is None:
                if n >= least:
                    matches.append((i - 1, n, s))
                s = n = 0
                continue
            if w in nxt[s]:
                s = nxt[s][w]
                n += 1
            else:
                if n >= least:
                    matches.append((i - 1, n, s))
                while s and w not in nxt[s]:
                    s = link[s]
                    n = length[s]
                if w in nxt[s]:
                    s = nxt[s][w]
                    n += 1
            if ends[s]:
                found += [(p, i, n) for p in ends[s]]
        if n >= least:
            matches.append((len(words) - 1, n, s))
        return found, matches


def _chains(matches, automaton: Automaton, lengths: list[int], gap: int):
    """(template, first word, word after the last, covered template words) of each chain."""
    open_: dict[int, list[int]] = {}  # template -> [start, end, template end, covered]
    for end, n, state in matches:
        for t, t_end in sorted(automaton.places[state]):
            start, t_start = end - n + 1, t_end - n + 1
            c = open_.get(t)
            if c and c[2] < t_end and start - c[1] <= gap and start + n > c[1]:
                new = min(n, t_end - c[2])  # an overlap with the chain counts once
                c[1], c[2], c[3] = end + 1, t_end, c[3] + new
            elif not c or start >= c[1] or n > c[3]:
                if c:
                    yield t, c[0], c[1], c[3] / lengths[t]
                open_[t] = [start, end + 1, t_end, n]
    for t, c in open_.items():
        yield t, c[0], c[1], c[3] / lengths[t]


def _scanner(templates: list[tuple[str, str]], base: dict[str, str], least: int, gap: int, coverage: float):
    texts = [words_of(text.encode()) for _, text in templates]
    phrases = [words_of(p.encode()) for p in base]
    automaton = Automaton(texts, phrases)
    lengths, sizes = [len(t) for t in texts], [len(p) for p in phrases]
    names = list(base.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            out: list[list] = [[] for _ in range(8)]
            for text in texts_of(rb.column(1)):
                words = words_of(text)
                found, matches = automaton.stream(words, least)
                starts = [(end - sizes[p] + 1, names[p]) for p, end, n in found if n >= sizes[p]]
                spans, best = [], 1.0 if starts else 0.0
                for t, a, b, c in _chains(matches, automaton, lengths, gap):
                    best = max(best, c)
                    if c >= coverage:
                        spans.append({"label": templates[t][0], "start": a, "end": b, "coverage": c})
                spans.sort(key=lambda x: (x["start"], x["end"], x["label"]))
                own = {name for _, name in starts}
                row = (len(words), len(starts), min(starts)[0] if starts else None, max(starts)[0] if starts else None,
                       ",".join(sorted(own)), ",".join(sorted(own | {x["label"] for x in spans})), best, spans)
                for column, value in zip(out, row):
                    column.append(value)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            span = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int32()), ("end", pa.int32()),
                                       ("coverage", pa.float64())]))
            yield pa.RecordBatch.from_arrays(
                [rb.column(0), *(pa.array(v, t) for v, t in zip(out, [*kinds, span]))],
                names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])
    return run


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, base: dict[str, str] | None = None,
         min_match: int = MIN_MATCH, max_gap: int = MAX_GAP, coverage: float = COVERAGE) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    ``spans`` are chains that cover at least ``coverage`` of a template (words
    from 0, end exclusive); ``score`` is the best coverage, 1 where a base phrase
    stands.

    Defined cases: null text is empty, without words, labels or score; a null id
    is a row like any other; repeated rows are each returned; overlapping places
    of a phrase all count; empty tables give no rows; other columns are not read.
    """
    run = _scanner(TEMPLATES if templates is None else templates, BASE if base is None else base,
                   min_match, max_gap, coverage)
    return text_rows(docs, F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        releasing(run), "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, "
             "labels string, score double, spans array<struct<label:string,start:int,end:int,coverage:double>>")
