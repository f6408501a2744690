"""Licence scan: matching statistics from a generalised suffix automaton."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W

PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Well-known public notices; the caller may pass others.
TEMPLATES = {
    "mit-text": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction including without limitation "
        "the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to "
        "permit persons to whom the software is furnished to do so subject to the following conditions"),
    "mit-notice": "released under the mit license",
    "apache-2.0-text": (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance "
        "with the license you may obtain a copy of the license at"),
    "apache-2.0-notice": "licensed under the apache license version 2 0",
    "gpl-3.0-text": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
        "public license as published by the free software foundation either version 3 of the license or at your "
        "option any later version"),
    "gpl-3.0-notice": "this work is licensed under the gnu general public license version 3",
    "bsd-text": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that "
        "the following conditions are met"),
    "isc-text": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
        "granted provided that the above copyright notice and this permission notice appear in all copies"),
    "cc-by-4.0-text": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-nc-4.0-notice": "licensed under cc by nc 4 0",
    "mpl-2.0-text": (
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was "
        "not distributed with this file you can obtain one at"),
}


@dataclass(frozen=True)
class Scan:
    """A match of ``least_words`` words is long; matches of one template in its
    order, at most ``gap`` words apart on either side, make one span; a span of
    at least ``coverage`` of its template gives the template's label."""

    least_words: int = 3
    gap: int = 8
    coverage: float = 0.6


class Automaton:
    """Suffix automaton of several token sequences.

    Each state knows, for every template its words occur in, one place where
    they end, and the sequences that end whole wherever its words do.
    """

    def __init__(self, sequences: list[list[int]]):
        self.step: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        self.ends: list[dict[int, int]] = [{}]
        for k, sequence in enumerate(sequences):
            last = 0
            for place, token in enumerate(sequence):
                last = self._extend(last, token)
                self.ends[last].setdefault(k, place)
        for state in sorted(range(1, len(self.size)), key=lambda s: -self.size[s]):
            for k, place in self.ends[state].items():
                up = self.ends[self.link[state]]
                up[k] = min(up.get(k, place), place)
        self.whole: list[list[int]] = [[] for _ in self.size]
        for k, sequence in enumerate(sequences):
            state = 0
            for token in sequence:
                state = self.step[state][token]
            if state:
                self.whole[state].append(k)
        self.length = [len(sequence) for sequence in sequences]
        for state in sorted(range(1, len(self.size)), key=lambda s: self.size[s]):
            self.whole[state] += self.whole[self.link[state]]

    def _state(self, size: int, step: dict[int, int], link: int) -> int:
        self.step.append(step)
        self.size.append(size)
        self.link.append(link)
        self.ends.append({})
        return len(self.size) - 1

    def _extend(self, last: int, token: int) -> int:
        known = self.step[last].get(token)
        if known is not None:
            return known if self.size[known] == self.size[last] + 1 else self._split(last, token, known)
        new = self._state(self.size[last] + 1, {}, 0)
        while last >= 0 and token not in self.step[last]:
            self.step[last][token] = new
            last = self.link[last]
        if last >= 0:
            target = self.step[last][token]
            self.link[new] = target if self.size[target] == self.size[last] + 1 else self._split(last, token, target)
        return new

    def _split(self, at: int, token: int, state: int) -> int:
        twin = self._state(self.size[at] + 1, dict(self.step[state]), self.link[state])
        self.link[state] = twin
        while at >= 0 and self.step[at].get(token) == state:
            self.step[at][token] = twin
            at = self.link[at]
        return twin

    def matches(self, tokens: list[int], least: int) -> Iterator[tuple[int, int, int]]:
        """(start, words, state) of every match that can't be extended to the right
        and has at least ``least`` words: the peaks of the matching statistics."""
        state = size = 0
        for place, token in enumerate(tokens):
            if token not in self.step[state]:
                if size >= least:
                    yield place - size, size, state
                while state and token not in self.step[state]:
                    state = self.link[state]
                    size = self.size[state]
            if token in self.step[state]:
                state = self.step[state][token]
                size += 1
        if size >= least:
            yield len(tokens) - size, size, state

    def places(self, tokens: list[int]) -> Iterator[tuple[int, int]]:
        """(start, sequence) of every place where a whole sequence stands."""
        state = size = 0
        for place, token in enumerate(tokens):
            while state and token not in self.step[state]:
                state = self.link[state]
                size = self.size[state]
            if token in self.step[state]:
                state = self.step[state][token]
                size += 1
            for k in self.whole[state]:
                if self.length[k] <= size:
                    yield place + 1 - self.length[k], k


def chained(matches: list[tuple[int, int, dict[int, int]]], how: Scan) -> dict[int, list[tuple[int, int, int]]]:
    """Spans (first word, end word, matched words) by template."""
    open_: dict[int, list[int]] = {}  # template -> first, end, matched, template place
    done: dict[int, list[tuple[int, int, int]]] = {}
    for start, size, ends in matches:
        for k, last in ends.items():
            begin = last - size + 1
            span = open_.get(k)
            if span and 0 <= start - span[1] <= how.gap and 0 <= begin - span[3] <= how.gap:
                open_[k] = [span[0], start + size, span[2] + size, last + 1]
            else:
                if span:
                    done.setdefault(k, []).append(tuple(span[:3]))
                open_[k] = [start, start + size, size, last + 1]
    for k, span in open_.items():
        done.setdefault(k, []).append(tuple(span[:3]))
    return done


def scanned(docs: DataFrame, templates: dict[str, str] = TEMPLATES, phrases: dict[str, str] = PHRASES,
            how: Scan = Scan()) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word,
    base_labels, labels, score and ``spans`` (label, first_word, end_word, coverage).

    ``score`` is 1 where a base phrase stands, else the best coverage of a
    template.  Null and empty texts have no word, no label and score 0; texts of any
    length are read whole; each row, repeated ones too, is judged by itself; spans
    that begin alike come by label; other columns are ignored, and an empty table
    gives an empty one.  The base places come from an automaton of the phrases, the
    spans from one of the templates.  A pair of words that no sequence has ends every
    match, so an automaton runs only over stretches without such pairs.
    """
    names = list(templates)
    vocabulary = {w: W.word_hash(w) for t in [*templates.values(), *phrases] for w in t.split()}
    # The automaton's tokens are the word hashes themselves.
    sequences = [[vocabulary[w] for w in templates[k].split()] for k in names]
    automaton = Automaton(sequences)
    said = {p: [vocabulary[w] for w in p.split()] for p in phrases if p.split()}
    base_labels, base_automaton = [phrases[p] for p in said], Automaton(list(said.values()))
    pairs, base_pairs = _pairs_of(sequences), _pairs_of(list(said.values()))
    alone = np.array([s[0] for s in said.values() if len(s) == 1], dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in W.groups(batch.column(1)):
                hashes, _, _, rows = W.words(data, offsets, W.ALPHANUMERIC)
                yield pa.RecordBatch.from_pylist(
                    list(_rows(batch.column(0).slice(first, end - first).to_pylist(), hashes, rows)), schema=_SCHEMA)

    def _rows(ids: list[int], hashes: np.ndarray, rows: np.ndarray) -> Iterator[dict]:
        of = np.repeat(np.arange(len(ids)), np.diff(rows))
        base: dict[int, list[tuple[int, str]]] = {}
        for row, begin, stretch in _stretches(hashes, rows, of, base_pairs, 2, alone):
            found = [(begin + s, base_labels[k]) for s, k in base_automaton.places(stretch)]
            base.setdefault(row, []).extend(found)
        spans: dict[int, list[dict]] = {}
        for row, begin, stretch in _stretches(hashes, rows, of, pairs, how.least_words):
            found = [(begin + s, n, automaton.ends[state]) for s, n, state in automaton.matches(stretch, how.least_words)]
            spans.setdefault(row, []).extend(found)
        for row, doc_id in enumerate(ids):
            own = base.get(row, [])
            kept = []
            for k, chains in chained(sorted(spans.get(row, []), key=lambda m: m[:2]), how).items():
                for a, b, matched in chains:
                    covered = min(matched / len(sequences[k]), 1.0)
                    kept.append({"label": names[k], "first_word": a, "end_word": b, "coverage": covered})
            best = max((s["coverage"] for s in kept), default=0.0)
            kept = [s for s in kept if s["coverage"] >= how.coverage]
            names_of = {label for _, label in own}
            yield {
                "doc_id": doc_id, "n_words": int(rows[row + 1] - rows[row]), "n_base": len(own),
                "first_word": min((p for p, _ in own), default=None), "last_word": max((p for p, _ in own), default=None),
                "base_labels": ",".join(sorted(names_of)),
                "labels": ",".join(sorted(names_of | {s["label"] for s in kept})),
                "score": 1.0 if own else best, "spans": sorted(kept, key=lambda s: (s["first_word"], s["label"])),
            }

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _DDL)


def _stretches(hashes: np.ndarray, rows: np.ndarray, of: np.ndarray, pairs: np.ndarray, least: int,
               alone: np.ndarray | None = None) -> Iterator[tuple[int, int, list[int]]]:
    """(row, first word, words) of maximal stretches whose neighbours are one of ``pairs``:
    those of at least ``least`` words, and single words that are in ``alone``."""
    if not len(hashes):
        return
    hit = np.zeros(len(hashes) - 1, dtype=bool)
    if len(pairs) and len(hit):
        key = _pair(hashes[:-1], hashes[1:])
        at = np.minimum(np.searchsorted(pairs, key), len(pairs) - 1)
        hit = (pairs[at] == key) & (of[1:] == of[:-1])
    edges = np.flatnonzero(np.concatenate([[True], ~hit, [True]]))
    size = np.diff(edges)
    wanted = size >= least
    if alone is not None and len(alone):
        wanted |= (size == 1) & np.isin(hashes[edges[:-1]], alone)
    for a, n in zip(edges[:-1][wanted].tolist(), size[wanted].tolist()):
        yield int(of[a]), a - int(rows[of[a]]), hashes[a : a + n].tolist()


_DDL = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, spans array<struct<label: string, first_word: long, end_word: long, coverage: double>>"
)
_SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()),
    ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
    ("spans", pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()),
                                  ("coverage", pa.float64())]))),
])


def _pairs_of(sequences: list[list[int]]) -> np.ndarray:
    return np.unique(np.array([_pair(a, b) for s in sequences for a, b in zip(s, s[1:])], dtype=np.uint64))


def _pair(a, b):
    with np.errstate(over="ignore"):
        return W.mixed(np.asarray(a, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.asarray(b, dtype=np.uint64))
