"""Licence detection by matching statistics against a generalised suffix automaton of licence texts.

Licence wordings are cut into words (ASCII lower case; letters, digits and everything beyond ASCII) and put into
one automaton. A document's words are streamed through it; every match of at least ``LEAST_MATCH`` words that
cannot be extended is placed in the wordings it occurs in. Matches that follow each other both in the document and
in one wording, with gaps of at most ``MAX_GAP`` words, form a chain. A chain that covers at least ``COVERAGE`` of
its wording is a covered span and gives the document the wording's label; the score is the best coverage of any
chain. Short wordings that must stand word for word are marked in the same automaton and counted at every place.

Null and empty texts have no words, no label and score 0. Repeated rows are each judged; no other column is read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merchlake.llm.batches import map_rows, words
from merchlake.llm.suffix_automaton import SuffixAutomaton

# Wordings counted at every place.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Wordings of licences and of the notices that name them.
WORDINGS = [
    ("mit", "Released under the MIT License"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
        " documentation files (the Software), to deal in the Software without restriction, including without"
        " limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of"
        " the Software, and to permit persons to whom the Software is furnished to do so",
    ),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    (
        "apache-2",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at"
        " http://www.apache.org/licenses/LICENSE-2.0",
    ),
    ("gpl-2", "This work is licensed under the GNU General Public License, version 2"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General"
        " Public License as published by the Free Software Foundation",
    ),
    ("lgpl", "licensed under the GNU Lesser General Public License"),
    ("agpl", "licensed under the GNU Affero General Public License"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that"
        " the following conditions are met",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is"
        " hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    ),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("proprietary", "All rights reserved. No part of this publication may be reproduced"),
]

LEAST_MATCH = 3
MAX_GAP = 4
COVERAGE = 0.9

_FOUND = (
    "id {id}, n_words long, places array<struct<label:string,first:int,last:int>>,"
    " spans array<struct<label:string,first:int,last:int,coverage:double>>, score double"
)


class LicenceMatcher:
    """The automaton, and where in the wordings each of its states occurs."""

    def __init__(self, wordings=WORDINGS, phrases=PHRASES, least=LEAST_MATCH, gap=MAX_GAP, coverage=COVERAGE):
        self.least, self.gap, self.coverage = least, gap, coverage
        self.items = [(label, words(text)) for label, text in wordings]
        self.automaton = SuffixAutomaton([*(item for _, item in self.items), *map(words, phrases)])
        for phrase, label in phrases.items():
            self.automaton.mark(words(phrase), label)
        self.automaton.settle()
        self.shortest = min([least, *(len(words(p)) for p in phrases)])
        # Ends of a state's runs, as (wording, number of the last word), for runs that can count.
        self.ends: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for number, (_, item) in enumerate(self.items):
            state = 0
            for at, word in enumerate(item):
                state = self.automaton.step[state][self.automaton.ids[word]]
                up = state
                while up > 0 and self.automaton.length[up] >= least:
                    self.ends[up].append((number, at))
                    up = self.automaton.link[up]

    def scan(self, stream: list[str]) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int, float]], float]:
        """Places of the phrases, covered spans, and the best coverage."""
        places: list[tuple[str, int, int]] = []
        # By wording: the open chain as [first, last, wording position, words covered].
        open_chains: dict[int, list[int]] = {}
        closed: list[tuple[int, int, int, int]] = []
        before = None

        def close(number: int) -> None:
            first, last, _, covered = open_chains.pop(number)
            closed.append((number, first, last, covered))

        def take(position: int, state: int, matched: int) -> None:
            for number, end in self.ends.get(state, ()):
                # Words that the chain has already are not counted again.
                first, start = position - matched + 1, end - matched + 1
                chain = open_chains.get(number)
                if chain:
                    overlap = max(0, chain[1] - first + 1, chain[2] - start + 1)
                    if (
                        overlap < matched
                        and first + overlap - chain[1] - 1 <= self.gap
                        and start + overlap - chain[2] - 1 <= self.gap
                    ):
                        chain[1], chain[2], chain[3] = position, end, chain[3] + matched - overlap
                        continue
                    if chain[1] - chain[0] >= matched and first <= chain[1]:
                        continue
                    close(number)
                open_chains[number] = [first, position, end, matched]

        for position, state, matched in self.automaton.matching(stream, self.shortest):
            for length, label in self.automaton.marks_at(state, matched):
                places.append((label, position - length + 1, position))
            # A match that goes on at the next word with one word more is not yet at its end.
            if before and not (position == before[0] + 1 and matched == before[2] + 1) and before[2] >= self.least:
                take(*before)
            before = position, state, matched
        if before and before[2] >= self.least:
            take(*before)
        for number in list(open_chains):
            close(number)

        spans, score = [], 1.0 if places else 0.0
        for number, first, last, covered in sorted(closed, key=lambda c: c[1:3]):
            label, item = self.items[number]
            share = min(1.0, covered / len(item))
            score = max(score, share)
            if share >= self.coverage:
                spans.append((label, first, last, share))
        return places, spans, score


def _scanner():
    matcher = LicenceMatcher()

    def row(doc_id, text) -> Iterator[tuple]:
        stream = words(text)
        places, spans, score = matcher.scan(stream)
        yield (
            doc_id,
            len(stream),
            [{"label": label, "first": first, "last": last} for label, first, last in places],
            [{"label": label, "first": a, "last": b, "coverage": share} for label, a, b, share in spans],
            score,
        )

    return row


def scan_licences(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id``, ``n_words``, ``places`` of the phrases, covered ``spans``, ``score``."""
    schema = _FOUND.format(id=dict(documents.dtypes)[id_col])
    return map_rows(documents.select(F.col(id_col), F.col(text_col)), lambda: _scanner(), schema)


def licence_digest(found: DataFrame) -> DataFrame:
    """Counts and labels of the result of :func:`scan_licences`."""

    def labels(*sources: str) -> F.Column:
        every = F.concat(*(F.transform(source, lambda x: x["label"]) for source in sources))
        return F.array_join(F.array_sort(F.array_distinct(every)), ",")

    first = F.transform("places", lambda x: x["first"])
    return found.select(
        "id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(first).cast("long").alias("first_word"),
        F.array_max(first).cast("long").alias("last_word"),
        labels("places").alias("base_labels"),
        labels("places", "spans").alias("labels"),
        "score",
    )
