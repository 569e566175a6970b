"""Prefix-tree join inside one candidate group: ordered n-gram sets in a compressed trie, walked for each set in one pass over arrays.

The sets of a group get one order (n-grams that most of its sets have come first), so near copies share
a long trunk. The trie is laid out in preorder: the n-grams of its edges in one array, and for each edge where it
is entered and left. A set's overlaps with all others are then running sums of what its edges have in common with it,
each edge counted once for all sets below. Sets of one component are not compared any more: a set is first held
against its neighbours in the trie, and the trie is walked if that leaves others of a fitting size.
"""

from __future__ import annotations

import numpy as np

FEW = 8  #: sets that are compared one by one instead of by a walk of the trie


class TrieJoin:
    """Links sets whose intersection is num/den of their union or more."""

    def __init__(self, sets: list[np.ndarray], num: int = 9, den: int = 10, joined: list | None = None):
        """joined: of each set, the component that it is known to be in."""
        first: dict = {}
        self.num, self.den, self.label = num, den, np.array([first.setdefault(x, i) for i, x in enumerate(joined or range(len(sets)))], np.int64)
        words, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        rank = np.empty(len(words), np.int64)
        rank[np.lexsort((words, -count))] = np.arange(len(words))
        ranks = np.split(rank[at].astype(np.int32), np.cumsum([len(s) for s in sets])[:-1])
        self.sets = [np.sort(r) for r in ranks]
        self.has = np.zeros(len(words), np.uint8)
        self._lay_out()

    def _lay_out(self) -> None:
        """order: of the sets in the trie; edges in preorder: tokens, starts; enters, leaves: their places among all steps; ends: the edge that each set ends at."""
        keys = [s.astype(">i4").tobytes() for s in self.sets]  # compare as the sets do
        self.order = sorted(range(len(keys)), key=keys.__getitem__)
        edges: list[tuple[int, int, int]] = []  # (set, from, to)
        same = [0] * (len(self.order) + 1)  # n-grams that a set shares with the one before
        for k in range(1, len(self.order)):
            a, b = self.sets[self.order[k - 1]], self.sets[self.order[k]]
            n = min(len(a), len(b))
            differ = np.flatnonzero(a[:n] != b[:n])
            same[k] = int(differ[0]) if len(differ) else n
        cuts: list[list[int]] = [[] for _ in self.order]  # depths at which later sets leave the edge that a set adds
        spans: list[tuple[int, int, int]] = []  # (set, from, to) of the path so far
        for k, i in enumerate(self.order):
            while spans and spans[-1][2] > same[k]:
                own, start, _ = spans.pop()
                if start < same[k]:
                    cuts[own].append(same[k])
                    spans.append((own, start, same[k]))
            if same[k] < len(self.sets[i]):
                spans.append((k, same[k], len(self.sets[i])))
        path: list[tuple[int, int]] = []  # (edge, its depth's end) of the path to the last set
        steps = 0
        enters, leaves, self.ends = [], [], np.zeros(len(self.sets), np.int64)
        for k, i in enumerate(self.order):
            while path and path[-1][1] > same[k]:
                leaves[path.pop()[0]] = steps
                steps += 1
            bounds = [same[k], *sorted(cuts[k]), len(self.sets[i])]
            for start, end in zip(bounds[:-1], bounds[1:]):
                if start < end:
                    path.append((len(edges), end))
                    edges.append((i, start, end))
                    enters.append(steps)
                    leaves.append(0)
                    steps += 1
            self.ends[i] = path[-1][0]
        while path:
            leaves[path.pop()[0]] = steps
            steps += 1
        self.tokens = np.concatenate([self.sets[i][a:b] for i, a, b in edges])
        self.starts = np.cumsum([0] + [b - a for _, a, b in edges])[:-1]
        self.enters, self.leaves, self.steps = np.array(enters), np.array(leaves), steps

    def _overlaps(self) -> np.ndarray:
        """Of all sets with the one that `has` marks."""
        own = np.add.reduceat(self.has[self.tokens], self.starts, dtype=np.int64)
        steps = np.zeros(self.steps, np.int64)
        steps[self.enters] = own
        steps[self.leaves] = -own
        return np.cumsum(steps)[self.enters[self.ends]]

    def find(self, x: int) -> int:
        return int(self.label[x])

    def links(self) -> list[tuple[int, int]]:
        """A spanning forest of the links, as pairs of numbers of sets."""
        found: list[tuple[int, int]] = []
        size = np.array([len(s) for s in self.sets])
        place = np.empty(len(self.sets), np.int64)
        place[self.order] = np.arange(len(self.sets))
        seen = np.zeros(len(self.sets), bool)
        for i in np.lexsort((np.arange(len(size)), size)).tolist():
            probe = self.sets[i]
            self.has[probe] = 1
            near = [self.order[p] for p in (place[i] - 1, place[i] + 1) if 0 <= p < len(self.order)]
            self._link(i, np.array([j for j in near if seen[j]], np.int64), size, found)
            fit = seen & (size * self.den >= self.num * len(probe))
            self._link(i, np.flatnonzero(fit & (self.label != self.label[i])), size, found)
            self.has[probe] = 0
            seen[i] = True
        return found

    def _link(self, i: int, others: np.ndarray, size: np.ndarray, found: list) -> None:
        """Joins the components of the others that are linked with i."""
        if len(others) > FEW:
            overlap = self._overlaps()[others]
        else:
            overlap = np.array([np.count_nonzero(self.has[self.sets[j]]) for j in others], np.int64)
        for j in others[(self.num + self.den) * overlap >= self.num * (size[i] + size[others])].tolist():
            a, b = self.label[i], self.label[j]
            if a != b:
                self.label[self.label == max(a, b)] = min(a, b)
                found.append((i, j))
