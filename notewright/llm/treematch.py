"""Simple tree matching of block trees by their shapes.

Simple tree matching takes, of two nodes of one kind (name and class words), the largest number of matching nodes
that keeps order and ancestry. It depends on the shapes of the trees alone, not on their texts. Equal subtrees have
one shape number, so what is computed for a pair of shapes holds for all pages that have them: pages of one
host share most shapes. Equal shapes match whole; equal shapes at the beginning and the end of two lists of
children are matched at once (no other match of these is larger), and the rest is a dynamic program.

A list pair of more than CELLS cells is matched in order instead, within a window, so memory and time stay linear.
Nothing here recurses: depth is bounded by memory alone.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np

from notewright.llm.dom import Node

CELLS, KINDS = 2_000_000, 40_000  #: of a dynamic program: cells, pairs of different shapes; more are matched in order
WINDOW = 64  #: children looked through for the same shape then


def nodes(tree: Node) -> list[Node]:
    """All nodes in page order."""
    out, stack = [], [tree]
    while stack:
        n = stack.pop()
        out.append(n)
        stack.extend(reversed(n.children))
    return out


class Shapes:
    """Shape numbers of trees, and what matching found about pairs of them."""

    def __init__(self):
        self.number: dict[tuple, int] = {}
        self.kind: list[tuple[str, str]] = []
        self.children: list[tuple[int, ...]] = []
        self.size: list[int] = []
        self.found: dict[tuple[int, int], tuple[int, list[tuple[int, int]]]] = {}

    def number_of(self, tree: Node) -> int:
        """Give every node of the tree its shape."""
        for n in reversed(nodes(tree)):
            below = tuple(c.shape for c in n.children)
            key = (n.name, n.words, below)
            if key not in self.number:
                self.number[key] = len(self.kind)
                self.kind.append((n.name, n.words))
                self.children.append(below)
                self.size.append(1 + sum(self.size[c] for c in below))
            n.shape = self.number[key]
        return tree.shape

    def _known(self, s: int, t: int) -> int | None:
        if s == t:
            return self.size[s]
        if self.kind[s] != self.kind[t]:
            return 0
        if not self.children[s] or not self.children[t]:
            return 1
        known = self.found.get((s, t))
        return None if known is None else known[0]

    def weight(self, s: int, t: int) -> int:
        """How many nodes of two trees of these shapes match, their roots included; 0 for roots of different kinds."""
        stack = [(s, t)]
        while stack:
            pair = stack[-1]
            if self._known(*pair) is not None:
                stack.pop()
                continue
            x, y, head, tail = self._trimmed(*pair)
            ahead = []
            if self._small(x, y):
                ahead = [(a, b) for a in set(x) for b in set(y) if self._known(a, b) is None]
            else:
                matched = self._in_order(x, y)
                ahead = [(x[i], y[j]) for i, j in matched if self._known(x[i], y[j]) is None]
            if ahead:
                stack.extend(ahead)
                continue
            if self._small(x, y):
                matched = self._best(x, y)
            n, m = len(self.children[pair[0]]), len(self.children[pair[1]])
            whole = [(i, i) for i in range(head)] + [(i + head, j + head) for i, j in matched] + [(n - k, m - k) for k in range(tail, 0, -1)]
            a, b = self.children[pair[0]], self.children[pair[1]]
            self.found[pair] = 1 + sum(self._known(a[i], b[j]) for i, j in whole), whole
        return self._known(s, t)

    def aligned(self, s: int, t: int) -> list[tuple[int, int]]:
        """Which children of two trees of one kind match, by number."""
        if s == t:
            return [(i, i) for i in range(len(self.children[s]))]
        self.weight(s, t)
        return self.found[s, t][1] if (s, t) in self.found else []

    def _trimmed(self, s: int, t: int):
        """Children between the equal ones at the beginning and at the end, and how many these are."""
        x, y = self.children[s], self.children[t]
        n = min(len(x), len(y))
        head = next((i for i in range(n) if x[i] != y[i]), n)
        tail = next((i for i in range(n - head) if x[-1 - i] != y[-1 - i]), n - head)
        return x[head : len(x) - tail], y[head : len(y) - tail], head, tail

    def _small(self, x, y) -> bool:
        return len(x) * len(y) <= CELLS and len(set(x)) * len(set(y)) <= KINDS

    def _best(self, x, y) -> list[tuple[int, int]]:
        if not x or not y:
            return []
        of_x, at_x = np.unique(x, return_inverse=True)
        of_y, at_y = np.unique(y, return_inverse=True)
        known = np.array([[self._known(a, b) for b in of_y.tolist()] for a in of_x.tolist()], np.int32)
        best = np.zeros((len(x) + 1, len(y) + 1), np.int32)
        for i in range(len(x)):
            np.maximum.accumulate(np.maximum(best[i, 1:], best[i, :-1] + known[at_x[i]][at_y]), out=best[i + 1, 1:])
        out, i, j = [], len(x), len(y)
        while i and j:
            if best[i, j] == best[i - 1, j]:
                i -= 1
            elif best[i, j] == best[i, j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                out.append((i, j))
        return out[::-1]

    def _in_order(self, x, y) -> list[tuple[int, int]]:
        places: dict[int, list[int]] = {}
        for j, t in enumerate(y):
            places.setdefault(t, []).append(j)
        out, j = [], 0
        for i, s in enumerate(x):
            if j >= len(y):
                break
            same = places.get(s, [])
            k = bisect_left(same, j)
            if k < len(same) and same[k] - j < WINDOW:
                j = same[k]
            elif self.kind[s] != self.kind[y[j]]:
                continue
            out.append((i, j))
            j += 1
        return out


def matched(shapes: Shapes, a: Node, b: Node) -> list[tuple[Node, Node]]:
    """The matching nodes of two trees."""
    out, stack = [], [(a, b)] if shapes.weight(a.shape, b.shape) else []
    while stack:
        a, b = stack.pop()
        out.append((a, b))
        stack.extend((a.children[i], b.children[j]) for i, j in shapes.aligned(a.shape, b.shape))
    return out
