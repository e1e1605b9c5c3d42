"""Suffix automaton over sequences of words."""

from __future__ import annotations


class SuffixAutomaton:
    """Accepts every run of words of the sequences added so far; a run never spans two of them."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]

    def _clone(self, p: int, q: int, word) -> int:
        """A copy of state q for the runs that end a path through p."""
        copy = len(self.next)
        self.next.append(self.next[q].copy())
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def add(self, words) -> None:
        last = 0
        for word in words:
            q = self.next[last].get(word)
            if q is not None:  # known from an earlier sequence
                last = q if self.length[last] + 1 == self.length[q] else self._clone(last, q, word)
                continue
            state = len(self.next)
            self.next.append({})
            self.length.append(self.length[last] + 1)
            self.link.append(0)
            p = last
            while p >= 0 and word not in self.next[p]:
                self.next[p][word] = state
                p = self.link[p]
            if p >= 0:
                q = self.next[p][word]
                self.link[state] = q if self.length[p] + 1 == self.length[q] else self._clone(p, q, word)
            last = state

    def matches(self, words) -> list[int]:
        """Matching statistics: for each word, the length of the longest accepted run that ends there."""
        out, state, size = [], 0, 0
        step, link, length = self.next, self.link, self.length
        for word in words:
            while state and word not in step[state]:
                state = link[state]
                size = length[state]
            if word in step[state]:
                state = step[state][word]
                size += 1
            else:
                size = 0
            out.append(size)
        return out
