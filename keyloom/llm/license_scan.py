"""Licence scanning: matching statistics against a generalised suffix automaton of licence words, chained into spans."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from keyloom.llm.common import bounded_batches, map_columns, pick, texts

# The phrases that count as base labels.
BASE = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}
# Customary wordings of licence notices, by label.
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("bsd", "licensed under the bsd license"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc0", "dedicated to the public domain under cc0 1 0 universal"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]

#: Words of all templates; the automaton has two states a word at most.
MAX_TEMPLATE_WORDS = 500_000

#: A-Z lowered; all other ASCII that is neither letter nor digit made blank. Bytes of other characters are parts of words.
FOLD = bytes(b | 32 if 65 <= b <= 90 else b if b > 127 or chr(b).isalnum() else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split()


@dataclass
class State:
    length: int = 0
    link: int = -1
    next: dict[int, int] = field(default_factory=dict)
    ends: list[tuple[int, int]] = field(default_factory=list)  # (template, words of it up to here)
    phrases: list[tuple[int, str]] = field(default_factory=list)  # (words, label) of base phrases that end here


class SuffixAutomaton:
    """All substrings of several word sequences. Each state knows every place where its strings end."""

    def __init__(self, sequences: list[list[bytes]]) -> None:
        self.vocabulary: dict[bytes, int] = {}
        self.states = [State()]
        self.sizes = [len(s) for s in sequences]
        for t, sequence in enumerate(sequences):
            at = 0
            for k, word in enumerate(sequence):
                at = self._extend(at, self.vocabulary.setdefault(word, len(self.vocabulary)))
                self.states[at].ends.append((t, k + 1))
        for state in sorted(self.states, key=lambda s: -s.length):  # a suffix ends wherever the longer string does
            if state.link > 0:
                self.states[state.link].ends.extend(state.ends)
        for state in self.states:
            state.ends = sorted(set(state.ends))

    def _extend(self, last: int, word: int) -> int:
        states = self.states
        if (known := states[last].next.get(word)) is not None:
            if states[known].length == states[last].length + 1:
                return known
            return self._split(last, word, known)
        states.append(State(states[last].length + 1))
        new, at = len(states) - 1, last
        while at >= 0 and word not in states[at].next:
            states[at].next[word] = new
            at = states[at].link
        if at < 0:
            states[new].link = 0
        else:
            target = states[at].next[word]
            states[new].link = target if states[target].length == states[at].length + 1 else self._split(at, word, target)
        return new

    def _split(self, at: int, word: int, target: int) -> int:
        """Part the shorter strings of `target`, which end a walk from `at` by `word`, off into a state of their own."""
        states = self.states
        old = states[target]
        states.append(State(states[at].length + 1, old.link, dict(old.next), list(old.ends)))
        part = len(states) - 1
        old.link = part
        while at >= 0 and states[at].next.get(word) == target:
            states[at].next[word] = part
            at = states[at].link
        return part

    def walk(self, words: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """Matching statistics: (position, state, length) of the longest match that ends at each word, where it isn't empty."""
        states, get = self.states, self.vocabulary.get
        at, length, previous = 0, 0, -2
        for position, word in [(k, w) for k, w in enumerate(map(get, words)) if w is not None]:
            if position != previous + 1:
                at = length = 0
            previous = position
            while at and word not in states[at].next:
                at = states[at].link
                length = states[at].length
            if (to := states[at].next.get(word)) is not None:
                at, length = to, length + 1
            if length:
                yield position, at, length


@dataclass
class Scan:
    n_words: int = 0
    n_base: int = 0
    first: int | None = None
    last: int | None = None
    base: set[str] = field(default_factory=set)
    labels: set[str] = field(default_factory=set)
    score: float = 0.0
    spans: list[tuple[str, int, int, float]] = field(default_factory=list)  # label, first and last word, covered share


class LicenseScanner:
    """Scans texts for base phrases and for notices.

    templates: (label, text) pairs; whole licence texts will do. At each word the automaton gives the longest match, and its suffix links the
    longest one with each template, so no template's match hides another's. Matches of min_match words or more, each as long as
    it can be, are chained for each template while both sides move on, with gaps of max_gap words at most; of all
    chains that end in a match the one that covers most counts. A chain that covers min_cover of its template is a span and gives its label.
    """

    def __init__(self, min_match: int = 3, max_gap: int = 6, min_cover: float = 0.75, templates: list[tuple[str, str]] | None = None) -> None:
        self.min_match, self.max_gap, self.min_cover = min_match, max_gap, min_cover
        phrases = [p.encode().split() for p in BASE]
        templates = TEMPLATES if templates is None else templates
        self.labels = [label for label, _ in templates]
        self.automaton = SuffixAutomaton([words_of(t) for _, t in templates] + phrases)
        self._mark(phrases)
        self.places: list[list[tuple[int, int, int]] | None] = [None] * len(self.automaton.states)

    def _mark(self, phrases: list[list[bytes]]) -> None:
        """Each state learns the base phrases that end its longest string: those of its own strings and of its suffix links'."""
        states = self.automaton.states
        for words, label in zip(phrases, BASE.values(), strict=True):
            at = 0
            for word in words:
                at = states[at].next[self.automaton.vocabulary[word]]
            states[at].phrases.append((len(words), label))
        for state in sorted(states, key=lambda s: s.length):
            if state.link > 0:
                state.phrases.extend(states[state.link].phrases)

    def _places(self, state: int) -> list[tuple[int, int, int]]:
        """(template, words of it up to here, longest string of the state or its suffix links that ends there), made when first asked for."""
        if (known := self.places[state]) is None:
            states, longest, at = self.automaton.states, {}, state
            while at > 0 and states[at].length >= self.min_match:
                for template, reached in states[at].ends:
                    if template < len(self.labels):
                        longest.setdefault((template, reached), states[at].length)
                at = states[at].link
            known = self.places[state] = [(*place, n) for place, n in longest.items()]
        return known

    def scan(self, text: str) -> Scan:
        words, out = words_of(text), Scan()
        out.n_words = len(words)
        runs: dict[tuple[int, int], list[int]] = {}  # (template, place in the text less place in the template) -> first and last word
        matches: dict[int, list[tuple[int, int, int]]] = {}  # template -> first and last word, template words reached
        for position, state, length in self.automaton.walk(words):
            for n, label in self.automaton.states[state].phrases:
                if length >= n:
                    out.n_base += 1
                    start = position - n + 1
                    out.first = start if out.first is None else min(out.first, start)
                    out.last = start if out.last is None else max(out.last, start)
                    out.base.add(label)
            if length < self.min_match:
                continue
            for template, reached, longest in self._places(state):
                key = template, position - reached
                run = runs.get(key)
                if run and run[1] == position - 1:
                    run[1] = position
                    continue
                if run:
                    matches.setdefault(template, []).append((run[0], run[1], run[1] - key[1]))
                runs[key] = [position - min(length, longest) + 1, position]
        for (template, shift), (start, end) in runs.items():
            matches.setdefault(template, []).append((start, end, end - shift))
        for template, found in sorted(matches.items()):
            self._chain(template, sorted(found), out)
        out.spans.sort(key=lambda span: span[1:])
        out.labels |= out.base
        out.score = 1.0 if out.base else min(1.0, out.score)
        return out

    def _chain(self, template: int, found: list[tuple[int, int, int]], out: Scan) -> None:
        """Best chains of a template's matches, by dynamic programming over those that end shortly before; spans don't overlap."""
        covered, first, open_from = [], [], 0
        furthest: list[int] = []  # largest end so far
        for k, (start, end, reached) in enumerate(found):
            length = end - start + 1
            best, best_first = length, start
            furthest.append(max(end, furthest[-1]) if furthest else end)
            while open_from < k and furthest[open_from] < start - self.max_gap - 1:
                open_from += 1
            for j in range(open_from, k):
                _, before, upto = found[j]
                overlap = max(0, before + 1 - start, upto - (reached - length))
                near = start - before - 1 <= self.max_gap and reached - length - upto <= self.max_gap
                if near and overlap < length and end > before and reached > upto and covered[j] + length - overlap > best:
                    best, best_first = covered[j] + length - overlap, first[j]
            covered.append(best)
            first.append(best_first)
        size, taken = self.automaton.sizes[template], []
        for k in sorted(range(len(found)), key=lambda k: (-covered[k], first[k])):
            cover = min(1.0, covered[k] / size)
            out.score = max(out.score, cover)
            if cover < self.min_cover:
                break
            if all(found[k][1] < a or first[k] > b for a, b in taken):
                taken.append((first[k], found[k][1]))
                out.labels.add(self.labels[template])
                out.spans.append((self.labels[template], first[k], found[k][1], cover))


COLUMNS = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, spans array<struct<label string, first_word int, last_word int, cover double>>"
)


def scan_licenses(docs: DataFrame, min_match: int = 3, max_gap: int = 6, min_cover: float = 0.75, templates: DataFrame | None = None) -> DataFrame:
    """One row per document, from its whole text; see COLUMNS.

    templates: a table (label, text) of notices or whole licence texts, in place of TEMPLATES; it is read by the driver, and the automaton is made in each
    worker from it, so more than MAX_TEMPLATE_WORDS words in all are an error. Rows with a null or empty label or text count for nothing.

    Words are runs of characters other than ASCII signs, blanks and controls, A-Z lowered. n_base counts all
    places of base phrases, first_word and last_word are their smallest and largest start (null without any). labels has the
    base labels and those of spans, distinct, sorted and joined by commas; empty without any. score is 1
    with a base phrase, else the largest covered share of a template. Null texts are empty. Only the text
    matters: equal texts and repeated rows get equal values. No shuffle; a task holds one batch of texts.
    """
    bounded_batches(docs.sparkSession)

    held = tuple(TEMPLATES) if templates is None else _read_templates(templates)

    def run(batch: dict[str, list]) -> Iterator[dict[str, object]]:
        key = (min_match, max_gap, min_cover, held)
        if key not in _SCANNERS:
            _SCANNERS[key] = LicenseScanner(min_match, max_gap, min_cover, list(held))
        scans = [_SCANNERS[key].scan(t) for t in batch["text"]]
        yield {
            "doc_id": batch["doc_id"],
            "n_words": [s.n_words for s in scans],
            "n_base": [s.n_base for s in scans],
            "first_word": [s.first for s in scans],
            "last_word": [s.last for s in scans],
            "base_labels": [",".join(sorted(s.base)) for s in scans],
            "labels": [",".join(sorted(s.labels)) for s in scans],
            "score": [s.score for s in scans],
            "spans": [[dict(zip(("label", "first_word", "last_word", "cover"), x, strict=True)) for x in s.spans] for s in scans],
        }

    return map_columns(texts(docs), COLUMNS, run)


def _read_templates(templates: DataFrame) -> tuple[tuple[str, str], ...]:
    rows, words = [], 0
    for row in pick(templates, "label", "text").where("label <> '' AND text <> ''").orderBy("label", "text").toLocalIterator():
        words += len(words_of(row.text))
        if words > MAX_TEMPLATE_WORDS:
            raise ValueError(f"the templates have more than {MAX_TEMPLATE_WORDS} words")
        rows.append((row.label, row.text))
    return tuple(rows)


_SCANNERS: dict[tuple, LicenseScanner] = {}
