"""Edit distances: tables, traces, and an automaton over them."""

from __future__ import annotations

import numpy as np


def table(a: str, b: str, transpositions: bool = False) -> np.ndarray:
    """Distances of all prefixes; with transpositions the restricted variant."""
    d = np.zeros((len(a) + 1, len(b) + 1), np.int64)
    d[:, 0], d[0, :] = np.arange(len(a) + 1), np.arange(len(b) + 1)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            best = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if transpositions and i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                best = min(best, d[i - 2, j - 2] + 1)
            d[i, j] = best
    return d


def distance(a: str, b: str, transpositions: bool = False) -> int:
    return int(table(a, b, transpositions)[-1, -1])


def osa_within(a: str, b: str, k: int) -> bool:
    return abs(len(a) - len(b)) <= k and distance(a, b, True) <= k


def trace(a: str, b: str, transpositions: bool = False) -> list[tuple[str, str, str]]:
    """Steps (operation, from, to) of a cheapest way from a to b."""
    d, i, j = table(a, b, transpositions), len(a), len(b)
    steps = []
    while i or j:
        if i and j and a[i - 1] == b[j - 1] and d[i, j] == d[i - 1, j - 1]:
            i, j, step = i - 1, j - 1, ("match", a[i - 1], b[j - 1])
        elif transpositions and i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1] and d[i, j] == d[i - 2, j - 2] + 1:
            i, j, step = i - 2, j - 2, ("transpose", a[i - 2 : i], b[j - 2 : j])
        elif i and j and d[i, j] == d[i - 1, j - 1] + 1:
            i, j, step = i - 1, j - 1, ("substitute", a[i - 1], b[j - 1])
        elif i and d[i, j] == d[i - 1, j] + 1:
            i, step = i - 1, ("delete", a[i - 1], "")
        else:
            j, step = j - 1, ("insert", "", b[j - 1])
        steps.append(step)
    return steps[::-1]


class LevenshteinAutomaton:
    """Accepts the words within k edits; a state is a row of the distance table, capped at k + 1."""

    def __init__(self, word: str, k: int, transpositions: bool = False):
        self.word, self.k, self.transpositions = word, k, transpositions
        self.start = (tuple(min(i, k + 1) for i in range(len(word) + 1)), None, "")
        self._known: dict = {}

    def step(self, state, char: str):
        key = (state, char if char in self.word else "\0")
        if key not in self._known:
            row, before, last = state
            new = [min(row[0] + 1, self.k + 1)]
            for i, c in enumerate(self.word, 1):
                best = min(row[i] + 1, new[i - 1] + 1, row[i - 1] + (c != char))
                if before is not None and i > 1 and c == last and self.word[i - 2] == char:
                    best = min(best, before[i - 2] + 1)
                new.append(min(best, self.k + 1))
            self._known[key] = (tuple(new), row if self.transpositions else None, char if self.transpositions else "")
        return self._known[key]

    def is_dead(self, state) -> bool:
        return min(state[0]) > self.k

    def accepts_state(self, state) -> bool:
        return state[0][-1] <= self.k

    def accepts(self, text: str) -> bool:
        state = self.start
        for c in text:
            state = self.step(state, c)
            if self.is_dead(state) and not self.transpositions:
                return False
        return self.accepts_state(state)

    def states(self) -> int:
        """Reachable states over the word's characters and one other."""
        seen, todo = {self.start}, [self.start]
        while todo:
            s = todo.pop()
            for c in {*self.word, "\0"}:
                n = self.step(s, c)
                if n not in seen and not self.is_dead(n):
                    seen.add(n)
                    todo.append(n)
        return len(seen)
