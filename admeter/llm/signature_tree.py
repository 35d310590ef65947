"""Links between sets of tokens by signature trees.

A leaf holds up to ``LEAF`` sets, each with a bitmap of its hashed tokens; a node above holds the OR of its children's bitmaps,
the range of their sizes, and the most tokens by which a set exceeds the bits it sets.  Two nodes are traversed together
and dropped as soon as their sizes differ too much, their common bits allow too little overlap, or all their sets
are connected already.  Pairs of sets that are left are counted exactly.
"""

from __future__ import annotations

import numpy as np

LEAF, FANOUT = 32, 8


class Union:
    def __init__(self, labels: list):
        first: dict = {}
        self.up = [first.setdefault(x, i) for i, x in enumerate(labels)]

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


class Node:
    __slots__ = ("bits", "least", "most", "slack", "children", "sets", "whole")

    def __init__(self, bits, sizes, slack, children, sets):
        self.bits, self.least, self.most, self.slack = bits, sizes[0], sizes[1], slack
        self.children, self.sets, self.whole = children, sets, False


def bitmaps(sets: list[np.ndarray], bits: int) -> np.ndarray:
    """A row of 64-bit words for each set; a token sets the bit that its leading bits name."""
    out = np.zeros((len(sets), bits), bool)
    shift = np.uint64(64 - (bits - 1).bit_length())
    for row, tokens in zip(out, sets):
        row[(tokens >> shift).astype(np.int64)] = True
    return np.packbits(out, axis=1).view(np.uint64)


def grown(order: np.ndarray, maps: np.ndarray, sizes: np.ndarray) -> Node:
    slack = sizes - np.bitwise_count(maps).sum(axis=1)
    level = [Node(np.bitwise_or.reduce(maps[x], axis=0), (sizes[x].min(), sizes[x].max()), slack[x].max(), [], x)
             for x in (order[i:i + LEAF] for i in range(0, len(order), LEAF))]
    while len(level) > 1:
        level = [Node(np.bitwise_or.reduce([n.bits for n in x], axis=0), (min(n.least for n in x), max(n.most for n in x)),
                      max(n.slack for n in x), x, np.concatenate([n.sets for n in x])) for x in (level[i:i + FANOUT] for i in range(0, len(level), FANOUT))]
    return level[0]


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Tokens of two sorted sets in both."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def links(sets: list[np.ndarray], percent: int, labels: list | None = None, sides: list[int] | None = None) -> list[tuple[int, int]]:
    """Pairs (i, j) with 100 |both| >= percent |either| that connect all sets which such pairs connect.

    Sets with equal ``labels`` count as connected already.  If there are sets of two ``sides``, 0 and 1, only those of different sides are compared.
    """
    union = Union(labels if labels is not None else list(range(len(sets))))
    sizes = np.array([len(s) for s in sets])
    if len(sets) == 2:
        both = common(*sets)
        linked = 100 * both >= percent * (int(sizes.sum()) - both) and union.join(0, 1)
        return [(0, 1)] if linked else []
    bits = 1 << max(8, min(16, int(2 * sizes.max() - 1).bit_length()))
    maps = bitmaps(sets, bits)
    order = np.lexsort((np.array([s[0] for s in sets]), sizes))
    out: list[tuple[int, int]] = []

    def connected(node: Node) -> bool:
        if not node.whole:
            first = union.find(int(node.sets[0]))
            node.whole = all(union.find(i) == first for i in node.sets.tolist())
        return node.whole

    def leaves(x: Node, y: Node) -> None:
        both = np.bitwise_count(maps[x.sets][:, None, :] & maps[y.sets][None, :, :]).sum(axis=2)
        bound = both + np.minimum(slack[x.sets][:, None], slack[y.sets][None, :])
        total = sizes[x.sets][:, None] + sizes[y.sets][None, :]
        for i, j in np.argwhere((100 + percent) * bound >= percent * total).tolist():
            a, b = int(x.sets[i]), int(y.sets[j])
            if (x is not y or i < j) and union.find(a) != union.find(b):
                shared = common(sets[a], sets[b])
                if 100 * shared >= percent * (int(total[i, j]) - shared):
                    union.join(a, b)
                    out.append((a, b))

    slack = sizes - np.bitwise_count(maps).sum(axis=1)
    side = np.array(sides if sides is not None else [0] * len(sets))[order]
    roots = [grown(order[side == x], maps, sizes) for x in np.unique(side)]
    todo = [(roots[0], roots[-1])]
    while todo:
        x, y = todo.pop()
        if 100 * x.most < percent * y.least or 100 * y.most < percent * x.least:
            continue
        bound = int(np.bitwise_count(x.bits & y.bits).sum()) + min(x.slack, y.slack)
        if (100 + percent) * bound < percent * (x.least + y.least):
            continue
        if connected(x) and connected(y) and union.find(int(x.sets[0])) == union.find(int(y.sets[0])):
            continue
        if not x.children and not y.children:
            leaves(x, y)
        elif x is y:
            kids = x.children
            todo += [(kids[i], kids[j]) for i in range(len(kids)) for j in range(i, len(kids))]
        elif x.children and (not y.children or len(x.sets) >= len(y.sets)):
            todo += [(k, y) for k in x.children]
        else:
            todo += [(x, k) for k in y.children]
    return out
