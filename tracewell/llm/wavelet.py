"""Dual-sorted inverted lists in one wavelet tree: each list is ordered by impact, and the tree is cut by document.

The lists of all terms stand one after the other as a sequence of document numbers. Level by level, bit by bit, the
sequence is parted into documents with a 0 and with a 1, each part in its old order. A term's list is a range of the
sequence at every node; since the order is kept, the first entry of a range has the term's largest impact on any of the
node's documents. The sum of these over a query's terms is a bound for all documents below the node, and at a leaf,
which is one document, the score itself.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np

#: Nodes of one level that are opened at once.
WIDTH = 128


class Tree:
    """``terms``, ``docs`` and ``impacts`` are equally long: a posting each; terms are numbered from 0 to n_terms - 1,
    documents from 0 to n_docs - 1, and a term has a document once at most. Impacts are above 0 and below 2**31."""

    def __init__(self, terms: np.ndarray, docs: np.ndarray, impacts: np.ndarray, n_terms: int, n_docs: int) -> None:
        order = np.lexsort((docs, -impacts, terms))
        docs, self.levels = docs[order].astype(np.int32), max(1, int(n_docs - 1).bit_length())
        impact = impacts[order].astype(np.int32)
        self.starts = np.searchsorted(terms[order], np.arange(n_terms + 1)).astype(np.int64)
        self.zeros: list[np.ndarray] = []  # for each level, the zeros before a place
        self.impacts = [impact]
        for level in range(self.levels):
            bit = (docs >> (self.levels - 1 - level)) & 1
            zeros = np.zeros(len(docs) + 1, np.int32)
            np.cumsum(1 - bit, out=zeros[1:])
            self.zeros.append(zeros)
            ones = bit.astype(bool)
            docs, impact = (np.concatenate([x[~ones], x[ones]]) for x in (docs, impact))
            self.impacts.append(impact)

    def best(self, terms: np.ndarray, weights: np.ndarray, k: int, least: int = 1, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of the k largest sums of weight x impact that are ``least`` or more, largest first, equal
        ones by number; a weight is 0 or more. Nodes are opened from the largest bound down, ``width`` at a time, and
        left closed once their bound is below the k-th score found."""
        docs, scores = np.empty(0, np.int64), np.empty(0, np.int64)
        begin, end = self.starts[terms], self.starts[terms + 1]
        use = (end > begin) & (weights > 0)
        if not use.any():
            return docs, scores
        root = _Nodes(0, np.zeros(1, np.int64), np.zeros(int(use.sum()), np.int64), begin[use], end[use], weights[use].astype(np.int64))
        root.bound(self.impacts[0])
        heap, n = [(-int(root.bounds[0]), 0, root)], 0
        while heap and -heap[0][0] >= least:
            nodes = heapq.heappop(heap)[2]
            nodes = nodes.taken(nodes.bounds >= least)
            if len(nodes.bounds) > width:
                edge = np.argpartition(-nodes.bounds, width)
                first = np.zeros(len(nodes.bounds), bool)
                first[edge[:width]] = True
                rest = nodes.taken(~first)
                n += 1
                heapq.heappush(heap, (-int(rest.bounds.max()), n, rest))
                nodes = nodes.taken(first)
            nodes = self._opened(nodes, least)
            if not len(nodes.bounds):
                continue
            if nodes.level < self.levels:
                n += 1
                heapq.heappush(heap, (-int(nodes.bounds.max()), n, nodes))
                continue
            docs, scores = np.concatenate([docs, nodes.prefix]), np.concatenate([scores, nodes.bounds])
            order = np.lexsort((docs, -scores))[:k]
            docs, scores = docs[order], scores[order]
            if len(scores) == k:
                least = max(least, int(scores[-1]))
        return docs, scores

    def _opened(self, nodes: _Nodes, least: int) -> _Nodes:
        """The children whose bound is ``least`` or more."""
        zeros, level = self.zeros[nodes.level], nodes.level + 1
        a, b, parts = zeros[nodes.begin].astype(np.int64), zeros[nodes.end].astype(np.int64), []
        for bit, begin, end in ((0, a, b), (1, zeros[-1] + nodes.begin - a, zeros[-1] + nodes.end - b)):
            some = end > begin
            owner = nodes.owner[some]
            if not len(owner):
                continue
            new = np.concatenate([[True], owner[1:] != owner[:-1]])
            child = _Nodes(level, nodes.prefix[owner[new]] * 2 + bit, np.cumsum(new) - 1, begin[some], end[some], nodes.weight[some])
            child.bound(self.impacts[level])
            parts.append(child.taken(child.bounds >= least))
        return _joined(parts, level)


@dataclass
class _Nodes:
    """Nodes of one level: ``prefix`` names them; range j (from begin to end, of a term with this weight) is of node
    ``owner[j]``; ranges of a node are neighbours."""

    level: int
    prefix: np.ndarray
    owner: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    weight: np.ndarray
    bounds: np.ndarray | None = None

    def bound(self, impacts: np.ndarray) -> None:
        at = np.flatnonzero(np.concatenate([[True], self.owner[1:] != self.owner[:-1]]))
        self.bounds = np.add.reduceat(self.weight * impacts[self.begin], at)

    def taken(self, some: np.ndarray) -> _Nodes:
        if some.all():
            return self
        ranges = some[self.owner]
        owner = (np.cumsum(some) - 1)[self.owner[ranges]]
        return _Nodes(self.level, self.prefix[some], owner, self.begin[ranges], self.end[ranges], self.weight[ranges], self.bounds[some])


def _joined(parts: list[_Nodes], level: int) -> _Nodes:
    none = np.empty(0, np.int64)
    if not parts:
        return _Nodes(level, none, none, none, none, none, none)
    if len(parts) == 1:
        return parts[0]
    a, b = parts
    return _Nodes(level, *(np.concatenate([x, y]) for x, y in ((a.prefix, b.prefix), (a.owner, b.owner + len(a.prefix)), (a.begin, b.begin), (a.end, b.end), (a.weight, b.weight), (a.bounds, b.bounds))))
