"""Licence scan: a suffix automaton of licence wording, matching statistics, chains of long matches."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame

from recordloom.llm.common import parts, text_list, worker_memory

# Phrases that are looked for as they stand, with their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Paragraphs of public licences and notes that name them.
TEMPLATES = [
    ("gpl", "licensed under the gnu general public license version"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    ("gpl", "you should have received a copy of the gnu general public license along with this program"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("isc", "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"),
]

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


class Automaton:
    """Generalised suffix automaton of lists of words."""

    def __init__(self, templates: list[tuple[str, str]], phrases: dict[str, str]):
        self.templates = [(label, text.encode().split()) for label, text in [*templates, *((b, a) for a, b in phrases.items())]]
        self.steps: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[dict[int, int]] = [{}]  # template: end of its first occurrence there
        ended = {}
        for n, (_, words) in enumerate(self.templates):
            state = 0
            for i, word in enumerate(words):
                state = self.extend(state, word)
                self.note(state, n, i + 1)
            ended[n] = state
        order = sorted(range(1, len(self.link)), key=lambda s: -self.length[s])
        for s in order:  # what ends in a state also ends in the states of its shorter ends
            for n, end in self.ends[s].items():
                self.note(self.link[s], n, end)
        # phrases that end wherever a state is reached by a match of their length
        self.found: list[list[tuple[int, str]]] = [[] for _ in self.link]
        first = self.phrases_from = len(self.templates) - len(phrases)
        places = {ended[n]: (len(self.templates[n][1]), self.templates[n][0]) for n in range(first, len(self.templates))}
        for s in range(1, len(self.link)):
            up = s
            while up > 0:
                if up in places:
                    self.found[s].append(places[up])
                up = self.link[up]

    def note(self, state: int, template: int, end: int) -> None:
        if state > 0:
            self.ends[state][template] = min(end, self.ends[state].get(template, end))

    def new(self, length: int, steps: dict, link: int) -> int:
        self.steps.append(dict(steps))
        self.link.append(link)
        self.length.append(length)
        self.ends.append({})
        return len(self.link) - 1

    def split(self, state: int, word: bytes) -> int:
        """The state that ``word`` leads to from ``state``, made the longest of its own class."""
        to = self.steps[state][word]
        if self.length[to] == self.length[state] + 1:
            return to
        copy = self.new(self.length[state] + 1, self.steps[to], self.link[to])
        self.link[to] = copy
        while state >= 0 and self.steps[state].get(word) == to:
            self.steps[state][word] = copy
            state = self.link[state]
        return copy

    def extend(self, last: int, word: bytes) -> int:
        if word in self.steps[last]:
            return self.split(last, word)
        state = self.new(self.length[last] + 1, {}, 0)
        while last >= 0 and word not in self.steps[last]:
            self.steps[last][word] = state
            last = self.link[last]
        if last >= 0:
            self.link[state] = self.split(last, word)
        return state

    def scan(self, words: list[bytes], shortest: int) -> tuple[list[tuple[int, str]], list[tuple[int, int, int]]]:
        """Places of phrases ``(word, label)``, and matches that cannot grow ``(end, state, length)``."""
        steps, link, lengths, found = self.steps, self.link, self.length, self.found
        places, matches, state, length, known = [], [], 0, 0, self.steps[0]
        for i, word in enumerate(words):
            if word not in known:  # in no template
                if length >= shortest:
                    matches.append((i, state, length))
                state = length = 0
                continue
            to = steps[state].get(word)
            if to is None:
                if length >= shortest:
                    matches.append((i, state, length))
                while to is None:
                    state = link[state]
                    to = steps[state].get(word)
                length = lengths[state]
            state = to
            length += 1
            for size, label in found[state]:
                if length >= size:
                    places.append((i - size + 1, label))
        if length >= shortest:
            matches.append((len(words), state, length))
        return places, matches

    def chains(self, matches: list[tuple[int, int, int]], gap: int) -> list[tuple[str, int, int, float]]:
        """``(label, start, end, share)``: matches in a template's order, at most ``gap`` words apart, and the share of it they cover.

        Of a phrase only the whole counts.
        """
        out, open_chain = [], {}
        for end, state, length in matches:
            for n, to in self.ends[state].items():
                begin, at = end - length, to - length
                chain = open_chain.get(n)
                if chain and begin - chain[1] <= gap and begin >= chain[1] and at >= chain[2]:
                    chain[1], chain[2], chain[3] = end, to, chain[3] + length
                else:
                    if chain:
                        out.append((n, *chain))
                    open_chain[n] = [begin, end, to, length]
        out += [(n, *chain) for n, chain in open_chain.items()]
        # a phrase is too short for a part of it to say anything
        return sorted(
            (self.templates[n][0], begin, end, covered / len(self.templates[n][1])) for n, begin, end, _, covered in out
            if n < self.phrases_from or covered >= len(self.templates[n][1])
        )


SPANS = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("share", pa.float64())]))
PLACES = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))


def _scan(batches: Iterator[pa.RecordBatch], templates: list, phrases: dict, share: float, shortest: int, gap: int) -> Iterator[pa.RecordBatch]:
    memory, name = worker_memory(), ("licences", str(templates), str(phrases))
    if name not in memory:
        memory[name] = Automaton(templates, phrases)
    automaton = memory[name]
    for part in parts(batches, "text"):
        n_words, places, spans, score = [], [], [], []
        for text in text_list(part.column("text")):
            words = WORD.findall(text.encode().lower())  # of bytes: only A-Z change
            found, matches = automaton.scan(words, shortest)
            chains = automaton.chains(matches, gap)
            n_words.append(len(words))
            places.append([{"label": label, "word": i} for i, label in found])
            spans.append([{"label": a, "start": b, "end": e, "share": s} for a, b, e, s in chains if s >= share])
            score.append(max((s for *_, s in chains), default=0.0))
        yield pa.record_batch({
            "key": part.column("key"), "n_words": pa.array(n_words, pa.int64()), "places": pa.array(places, PLACES),
            "spans": pa.array(spans, SPANS), "score": pa.array(score, pa.float64()),
        })


def scan(df: DataFrame, key: str, text: str, templates: list[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES,
         share: float = 0.6, shortest: int = 2, gap: int = 8) -> DataFrame:
    """``key, n_words, places, spans, score`` of every whole text.

    Words are runs of digits, letters and non-ASCII characters, A-Z in lower case. The words
    stream through the automaton of all templates and phrases, which gives the longest match
    that ends at each word. ``places`` are all the places of ``phrases`` (label and first word).
    Matches of at least ``shortest`` words that cannot grow are chained in template order over
    gaps of up to ``gap`` words; ``spans`` are the chains that cover at least ``share`` of a
    template, and ``score`` is the largest share covered, 0 without a match.

    A null text counts as empty: no words, no spans, score 0. Repeated rows and null keys
    stay, other columns are left out. No shuffle, memory bounded by a part or the longest text.
    """
    rows = df.select(df[key].alias("key"), df[text].alias("text"))
    kind = df.schema[key].dataType.simpleString()
    out = rows.mapInArrow(
        partial(_scan, templates=templates, phrases=phrases, share=share, shortest=shortest, gap=gap),
        f"key {kind}, n_words long, places array<struct<label:string,word:long>>, "
        "spans array<struct<label:string,start:long,end:long,share:double>>, score double",
    )
    return out.withColumnRenamed("key", key)
