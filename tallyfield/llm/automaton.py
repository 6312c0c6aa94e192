"""Tries and Levenshtein automata."""

from __future__ import annotations

from collections.abc import Iterable

END = ""


def build_trie(words: Iterable[str]) -> dict:
    """Nested dicts by letter; END marks a word."""
    root: dict = {}
    for w in words:
        node = root
        for c in w:
            node = node.setdefault(c, {})
        node[END] = True
    return root


class LevenshteinAutomaton:
    """Accepts the words within k edits of a query: a letter more, less or other, or two swapped.

    A state holds, for the query positions within k of the letters read, the least number of
    edits, and as much of the state before as a swap needs. It is kept relative to the letters
    read, and a step depends only on the state, on which of the next query letters equal the
    letter read and on how far the query goes; steps are made once and shared by all queries.
    """

    _steps: dict = {}

    def __init__(self, query: str, k: int) -> None:
        self.query, self.k, self.n = query, k, len(query)
        far = k + 1
        row = tuple(j if 0 <= j <= self.n else far for j in range(-k, k + 1))
        self.start = (row, (far,) * (2 * k + 1), 0)

    def step(self, state: tuple, depth: int, c: str) -> tuple | None:
        """The state after letter c when `depth` letters were read before; null if nothing can follow."""
        k, n, q = self.k, self.n, self.query
        bits = 0
        low = depth + 1 - k
        for d in range(-1, 2 * k + 1):
            j = low + d
            if 1 <= j <= n and q[j - 1] == c:
                bits |= 1 << (d + 1)
        left, right = max(0, -low), min(2 * k, n - low)
        key = (k, state, bits, left, right)
        hit = self._steps.get(key, 0)
        if hit != 0:
            return hit
        row, before, last = state
        far = k + 1
        out = []
        for d in range(2 * k + 1):
            if d < left or d > right:
                out.append(far)
                continue
            best = row[d + 1] + 1 if d < 2 * k else far
            if low + d >= 1:
                best = min(best, row[d] + (0 if bits >> (d + 1) & 1 else 1))
            if out and d > left:
                best = min(best, out[-1] + 1)
            if low + d >= 2 and bits >> d & 1 and last >> (d + 2) & 1:
                best = min(best, before[d] + 1)
            out.append(min(best, far))
        nxt = (tuple(out), row, bits) if min(out) <= k else None
        if len(self._steps) > 500_000:
            self._steps.clear()
        self._steps[key] = nxt
        return nxt

    def edits(self, state: tuple, depth: int) -> int:
        d = self.n - depth + self.k
        return state[0][d] if 0 <= d <= 2 * self.k else self.k + 1

    def search(self, trie: dict) -> list[tuple[str, int]]:
        """(word, edits) of every word of the trie that is accepted."""
        found, stack = [], [(trie, self.start, "")]
        while stack:
            node, state, word = stack.pop()
            for c, child in node.items():
                if c is END or c == END:
                    e = self.edits(state, len(word))
                    if e <= self.k:
                        found.append((word, e))
                    continue
                nxt = self.step(state, len(word), c)
                if nxt is not None:
                    stack.append((child, nxt, word + c))
        return found


def osa(a: str, b: str) -> int:
    """Edits between two words, with swaps of neighbours, by the full table."""
    prev, row = [0] * (len(b) + 1), list(range(len(b) + 1))
    older = prev
    for i, x in enumerate(a, 1):
        older, prev, row = prev, row, [i] + [0] * len(b)
        for j, y in enumerate(b, 1):
            row[j] = min(prev[j] + 1, row[j - 1] + 1, prev[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                row[j] = min(row[j], older[j - 2] + 1)
    return row[-1]
