"""A suffix automaton: every substring of a text as a path, so that one pass over a body finds the longest part of the text that it holds."""

from __future__ import annotations


class SuffixAutomaton:
    """States are sets of substrings with the same end positions; `length` is that of a state's longest, `first` the least end position."""

    def __init__(self, text: str):
        self.edges: list[dict[str, int]] = [{}]
        self.link, self.length, self.first = [-1], [0], [-1]
        last = 0
        for at, c in enumerate(text):
            last = self._extend(last, at, c)

    def _state(self, edges: dict[str, int], link: int, length: int, first: int) -> int:
        self.edges.append(edges)
        self.link.append(link)
        self.length.append(length)
        self.first.append(first)
        return len(self.link) - 1

    def _extend(self, last: int, at: int, c: str) -> int:
        new = self._state({}, 0, at + 1, at)
        while last >= 0 and c not in self.edges[last]:
            self.edges[last][c] = new
            last = self.link[last]
        if last < 0:
            return new
        old = self.edges[last][c]
        if self.length[old] > self.length[last] + 1:  # the shorter strings of `old` get the new end position, the longer ones don't
            short = self._state(dict(self.edges[old]), self.link[old], self.length[last] + 1, self.first[old])
            while last >= 0 and self.edges[last].get(c) == old:
                self.edges[last][c] = short
                last = self.link[last]
            self.link[old] = old = short
        self.link[new] = old
        return new

    def longest_in(self, body: str) -> tuple[int, int, int]:
        """(length, place in the text, place in the body) of the longest common substring: of equally long ones the first in the text, there its first place in the body. (0, 0, 0) without one."""
        edges, link, length = self.edges, self.link, self.length
        best = start = found = state = n = 0
        for at, c in enumerate(body):
            step = edges[state].get(c)
            while step is None and state:
                state = link[state]
                n = length[state]
                step = edges[state].get(c)
            if step is None:
                continue
            state, n = step, n + 1
            if n >= best:
                begins = self.first[state] - n + 1
                if n > best or begins < start:
                    best, start, found = n, begins, at - n + 1
        return best, start, found
