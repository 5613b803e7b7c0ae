"""Generalised suffix automaton over lists of words, and matching statistics of word streams against it."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np


class SuffixAutomaton:
    """Every run of consecutive words of every item, as states; built in time linear in the words given.

    ``marks[state]`` holds ``(length, payload)`` of the runs that :meth:`mark` named. A run of ``m`` words
    belongs to the one state whose lengths, from its suffix link's up to its own, include ``m``.
    """

    def __init__(self, items: Iterable[list[str]]):
        self.ids: dict[str, int] = {}
        self.step: list[dict[int, int]] = [{}]
        self.link: list[int] = [-1]
        self.length: list[int] = [0]
        self.marks: dict[int, list[tuple[int, object]]] = {}
        for item in items:
            last = 0
            for word in item:
                last = self._extend(last, self.ids.setdefault(word, len(self.ids) + 1))

    def _state(self, length: int, link: int, step: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.step.append(step)
        return len(self.length) - 1

    def _split(self, parent: int, word: int) -> int:
        """The state of the longest run of ``parent`` followed by ``word``, made if it has none of its own."""
        target = self.step[parent][word]
        if self.length[target] == self.length[parent] + 1:
            return target
        clone = self._state(self.length[parent] + 1, self.link[target], dict(self.step[target]))
        self.link[target] = clone
        while parent >= 0 and self.step[parent].get(word) == target:
            self.step[parent][word] = clone
            parent = self.link[parent]
        return clone

    def _extend(self, last: int, word: int) -> int:
        if word in self.step[last]:
            return self._split(last, word)
        new = self._state(self.length[last] + 1, 0, {})
        while last >= 0 and word not in self.step[last]:
            self.step[last][word] = new
            last = self.link[last]
        if last >= 0:
            self.link[new] = self._split(last, word)
        return new

    def mark(self, run: list[str], payload: object) -> None:
        """Attach ``payload`` to a run of words that occurs in an item."""
        state = 0
        for word in run:
            state = self.step[state][self.ids[word]]
        self.marks.setdefault(state, []).append((len(run), payload))

    def settle(self) -> None:
        """Let every state know the nearest states up its suffix links that carry marks."""
        self.marked_above = [-1] * len(self.link)
        for state in sorted(range(len(self.link)), key=self.length.__getitem__):
            up = self.link[state]
            if up >= 0:
                self.marked_above[state] = up if up in self.marks else self.marked_above[up]

    def marks_at(self, state: int, matched: int) -> Iterator[tuple[int, object]]:
        """Marked runs that end here, given the longest match and its state."""
        while state > 0:
            for length, payload in self.marks.get(state, ()):
                if length <= matched:
                    yield length, payload
            state = self.marked_above[state]

    def matching(self, stream: list[str], least: int = 1) -> Iterator[tuple[int, int, int]]:
        """``(position, state, longest match ending there)`` wherever that match may reach ``least`` words.

        Words that no item has end every match, so only runs of ``least`` known words are walked.
        """
        known = np.fromiter(map(self.ids.get, stream, repeat(0)), np.int32, len(stream))
        edges = np.flatnonzero(np.diff(np.concatenate(([False], known > 0, [False])).view(np.int8)))
        starts, ends = edges[::2], edges[1::2]
        keep = ends - starts >= least
        step, link, length = self.step, self.link, self.length
        for start, end in zip(starts[keep].tolist(), ends[keep].tolist()):
            state = matched = 0
            for position, word in enumerate(known[start:end].tolist(), start):
                following = step[state].get(word)
                while following is None:
                    state = link[state]
                    matched = length[state]
                    following = step[state].get(word)
                state = following
                matched += 1
                if matched >= least:
                    yield position, state, matched
