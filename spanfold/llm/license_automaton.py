"""License scans with a generalised suffix automaton of licence tokens.

The automaton holds every run of words of the licence templates.  A file's words
are streamed through it; at each word it tells the longest run ending there that
occurs in a template (matching statistics).  Words no template has reset it, so
only runs of template words of at least ``min_run`` words are streamed.  Each
maximal match names the templates that hold it and where.  Matches of one
template are chained in file and template order; the template words a chain
covers, over the template's length, is its coverage.  A template whose coverage
reaches ``min_cover`` gives its label; the score is the best coverage.

Three fixed phrases give base labels wherever their words stand consecutively.

Cases: null is an empty text (no words, no labels, score 0, null places); repeated
rows get equal results; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ID, TEXT, slices

# fixed values: the contract's phrases and labels
BASE_PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Short public notices by which licences are commonly named in files.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files, to deal in the Software without restriction"),
    ("mit", "released under the MIT License"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
            "that the following conditions are met"),
    ("gpl-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                   "General Public License as published by the Free Software Foundation"),
    ("gpl-notice", "This work is licensed under the GNU General Public License, version 3"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-notice", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted"),
    ("warranty-disclaimer", "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED"),
)

# word characters: digits, letters a-z after lower-casing, and every byte above ASCII
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32
               for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_WORDS).split() if text else []


class LicenseAutomaton:
    """Suffix automaton of several token lists; each state knows an end in every list that has it."""

    def __init__(self, templates=TEMPLATES):
        self.labels = [label for label, _ in templates]
        lists = [words_of(text) for _, text in templates]
        self.vocab: dict[bytes, int] = {}
        for words in (*lists, *(words_of(p) for p, _ in BASE_PHRASES)):
            for w in words:
                self.vocab.setdefault(w, len(self.vocab))
        self.sizes = [len(x) for x in lists]
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.ends = [-1], [0], [{}]
        for t, words in enumerate(lists):
            last = 0
            for pos, w in enumerate(words):
                last = self._extend(last, self.vocab[w])
                self.ends[last].setdefault(t, pos)
        # a state's shorter runs end wherever the state's do
        for s in sorted(range(1, len(self.link)), key=lambda s: -self.length[s]):
            for t, pos in self.ends[s].items():
                self.ends[self.link[s]].setdefault(t, pos)
        self.base = [([self.vocab[w] for w in words_of(p)], label) for p, label in BASE_PHRASES]

    def _state(self, length: int, nxt: dict, link: int) -> int:
        self.length.append(length)
        self.next.append(nxt)
        self.link.append(link)
        self.ends.append({})
        return len(self.link) - 1

    def _clone(self, p: int, q: int, c: int) -> int:
        copy = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:                         # a run of an earlier list goes on
            q = self.next[last][c]
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, q, c)
        cur, p = self._state(self.length[last] + 1, {}, 0), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, c)
        return cur

    def statistics(self, tokens: list[int]) -> Iterator[tuple[int, int]]:
        """For each token the state and length of the longest run ending there (unknown tokens: -1)."""
        state = size = 0
        for c in tokens:
            while state and c not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if c in self.next[state]:
                state, size = self.next[state][c], size + 1
            else:
                state = size = 0
            yield state, size

    def matches(self, tokens: np.ndarray, min_run: int) -> list[tuple[int, int, int]]:
        """Maximal runs (end, size, state) of at least ``min_run`` tokens."""
        known = tokens >= 0
        edges = np.flatnonzero(np.diff(np.concatenate(([False], known, [False])).astype(np.int8)))
        out = []
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if b - a < min_run:
                continue
            before = (0, 0)
            for k, (state, size) in enumerate(self.statistics(tokens[a:b].tolist())):
                if size <= before[1] >= min_run:
                    out.append((a + k - 1, before[1], before[0]))
                before = (state, size)
            if before[1] >= min_run:
                out.append((b - 1, before[1], before[0]))
        return out

    def coverage(self, found: list[tuple[int, int, int]]) -> dict[int, tuple[float, int, int]]:
        """Best chain of each template: (share of the template covered, first word, last word)."""
        chains: dict[int, list] = {}
        for end, size, state in found:
            for t, at in self.ends[state].items():
                # best[p]: (covered, first word) of a chain whose last match ends at template word p
                best, last = chains.setdefault(t, [{}, end])[:2]
                if end - size - last > 2 * self.sizes[t]:
                    best.clear()                         # too far apart: a new chain
                lo = at - size + 1
                chained = max(((c, f) for p, (c, f, _) in best.items() if p < lo), default=(0, end - size + 1),
                              key=lambda x: x[0])
                score = chained[0] + size
                if score > best.get(at, (0,))[0]:
                    best[at] = (score, chained[1], end)
                chains[t][1] = end
                top = chains[t][2] if len(chains[t]) > 2 else (0, 0, 0)
                if score > top[0]:
                    chains[t][2:] = [(score, chained[1], end)]
        return {t: (c[2][0] / self.sizes[t], c[2][1], c[2][2]) for t, c in chains.items()}

    def scan(self, text: str | None, min_run: int = 4, min_cover: float = 0.6) -> dict:
        words = words_of(text)
        tokens = np.fromiter((self.vocab.get(w, -1) for w in words), np.int32, len(words))
        places, base = [], set()
        for phrase, label in self.base:
            n = len(words) - len(phrase) + 1
            if n > 0:
                hit = np.ones(n, bool)
                for k, c in enumerate(phrase):
                    hit &= tokens[k:k + n] == c
                if hit.any():
                    base.add(label)
                    places.append(np.flatnonzero(hit))
        covers = self.coverage(self.matches(tokens, min_run))
        spans = sorted((self.labels[t], first, last, share) for t, (share, first, last) in covers.items()
                       if share >= min_cover)
        starts = np.concatenate(places) if places else None
        return {"n_words": len(words), "n_base": 0 if starts is None else len(starts),
                "first_word": None if starts is None else int(starts.min()),
                "last_word": None if starts is None else int(starts.max()),
                "base_labels": ",".join(sorted(base)),
                "labels": ",".join(sorted(base | {s[0] for s in spans})),
                "score": float(min(1.0, max((c[0] for c in covers.values()), default=0.0))),
                "spans": [{"label": a, "first": b, "last": c, "coverage": d} for a, b, c, d in spans]}


def scan(docs: DataFrame, templates=TEMPLATES, min_run: int = 4, min_cover: float = 0.6) -> DataFrame:
    """One row per document: word and phrase counts, labels, score and the covered spans."""
    kind = docs.schema[ID].dataType.simpleString()
    span = pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("coverage", pa.float64())])
    fields = [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
              ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(span))]
    schema = (f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, "
              "labels string, score double, spans array<struct<label:string,first:long,last:long,coverage:double>>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = LicenseAutomaton(templates)
        for part, texts in slices(batches):
            found = [automaton.scan(t, min_run, min_cover) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *(pa.array([x[n] for x in found], t) for n, t in fields)],
                ["doc_id", *(n for n, _ in fields)])

    return docs.select(F.col(ID).alias("doc_id"), F.col(TEXT).alias("text")).mapInArrow(run, schema)
