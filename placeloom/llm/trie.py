"""Hamming self-join of bit strings by walking a binary trie against itself.

A frontier of node pairs starts with every root paired with itself. Each step
replaces a pair by the pairs of its children; a pair of unlike children has one
more differing bit. A pair is pruned as soon as its differing bits exceed the
budget of its depth.

The budget of a depth: cut the string into ``budget + 1`` blocks. If two strings
differ in at most ``budget`` bits then, for one of the rotations of the blocks,
the first 1, 2, 3, ... blocks hold at most 0, 1, 2, ... differing bits (a cycle
lemma on the blocks' errors). One trie for each rotation with these rising
budgets therefore finds every pair, and the first block has to be equal, which
is the key that deals the tries' subtrees out to the tasks.

A subtree is a range of the sorted strings, so a step of the whole frontier is
a few numpy operations. Pairs whose leaves all lie in one component already are
pruned too: the result is a spanning forest, not all pairs of a dense group.
"""

from __future__ import annotations

import numpy as np

#: Node pairs kept in memory at once; a larger frontier is walked in slices.
SLICE = 1 << 16
#: Pairs of subtrees with at most so many leaf pairs are compared directly.
DIRECT = 24


def blocks(bits: int, budget: int) -> list[int]:
    """Widths of the ``budget + 1`` blocks, most significant first."""
    m = budget + 1
    return [bits // m + (i < bits % m) for i in range(m)]


def rotations(values: np.ndarray, bits: int, budget: int) -> list[np.ndarray]:
    """The values with block 0, 1, 2, ... rotated to the front."""
    out, shift = [], 0
    mask = np.uint64((1 << bits) - 1)
    for width in blocks(bits, budget):
        out.append(values if shift == 0 else ((values << np.uint64(shift)) | (values >> np.uint64(bits - shift))) & mask)
        shift += width
    return out


def rotated_widths(bits: int, budget: int, rotation: int) -> list[int]:
    w = blocks(bits, budget)
    return w[rotation:] + w[:rotation]


def depth_budgets(widths: list[int]) -> np.ndarray:
    """Differing bits allowed in the first d bits, d = 0 .. bits."""
    return np.array([0] + [i for i, w in enumerate(widths) for _ in range(w)], dtype=np.int8)


class Forest:
    """Labels of the leaves and the edges that joined them."""

    def __init__(self, label: np.ndarray):
        """label: of each leaf, below their number; leaves of one label count as joined."""
        self.label = label
        self.edges: list[tuple[np.ndarray, np.ndarray]] = []
        self._mark()

    def _mark(self) -> None:
        self.change = np.concatenate([[0], np.cumsum(self.label[1:] != self.label[:-1])]) if len(self.label) else np.zeros(0, int)

    def joined(self, lo: np.ndarray, hi: np.ndarray, lo2: np.ndarray, hi2: np.ndarray) -> np.ndarray:
        """True where both ranges hold leaves of one and the same component."""
        c = self.change
        return (c[hi - 1] == c[lo]) & (c[hi2 - 1] == c[lo2]) & (self.label[lo] == self.label[lo2])

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        """Join a[i] with b[i], keeping only edges that join two components."""
        label, grown = self.label, False
        while len(a):
            x, y = label[a], label[b]
            keep = x != y
            if not keep.any():
                break
            grown = True
            a, b, x, y = a[keep], b[keep], x[keep], y[keep]
            high, low = np.maximum(x, y), np.minimum(x, y)
            top, first = np.unique(high, return_index=True)
            self.edges.append((a[first], b[first]))
            to = np.arange(len(label))
            to[top] = low[first]
            while True:
                nxt = to[to]
                if (nxt == to).all():
                    break
                to = nxt
            label = to[label]
        if grown:
            self.label = label
            self._mark()


def _pairs(lo: np.ndarray, hi: np.ndarray, lo2: np.ndarray, hi2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All leaf pairs of the range pairs."""
    n, m = hi - lo, hi2 - lo2
    count = n * m
    at = np.repeat(np.arange(len(lo)), count)
    k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return lo[at] + k // m[at], lo2[at] + k % m[at]


def walk(group: np.ndarray, value: np.ndarray, bits: int, start: int, allowed: np.ndarray, budget: int, forest: Forest) -> None:
    """Join all leaves of a group that differ in at most ``budget`` bits under ``allowed`` (by depth).

    group, value: sorted by (group, value), distinct; the first ``start`` bits agree within a group.
    """
    n = len(value)
    cut = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if n else np.zeros(0, int)
    end = np.append(cut[1:], n)
    some = end - cut > 1
    lo, hi = cut[some], end[some]
    ones = [None] * bits

    def count_ones(d: int) -> np.ndarray:
        if ones[d] is None:
            ones[d] = np.concatenate([[0], np.cumsum((value >> np.uint64(bits - 1 - d)) & np.uint64(1), dtype=np.int64)])
        return ones[d]

    stack = [(start, lo, hi, lo, hi, np.zeros(len(lo), np.int8))]
    while stack:
        d, lo, hi, lo2, hi2, err = stack.pop()
        if len(lo) > SLICE:
            half = len(lo) // 2
            stack += [(d, *(x[:half] for x in (lo, hi, lo2, hi2, err))), (d, *(x[half:] for x in (lo, hi, lo2, hi2, err)))]
            continue
        fresh = ~forest.joined(lo, hi, lo2, hi2)
        lo, hi, lo2, hi2, err = (x[fresh] for x in (lo, hi, lo2, hi2, err))
        small = (hi - lo) * (hi2 - lo2) <= (DIRECT if d < bits else 1 << 62)
        if small.any():
            a, b = _pairs(lo[small], hi[small], lo2[small], hi2[small])
            near = (a < b) & (np.bitwise_count(value[a] ^ value[b]) <= budget)
            forest.add(a[near], b[near])
            lo, hi, lo2, hi2, err = (x[~small] for x in (lo, hi, lo2, hi2, err))
        if not len(lo):
            continue
        c = count_ones(d)
        mid, mid2 = hi - (c[hi] - c[lo]), hi2 - (c[hi2] - c[lo2])
        same = lo == lo2
        # like children; unlike children, of which a pair of a node with itself has but one
        a = np.concatenate([lo, mid, lo, mid[~same]])
        b = np.concatenate([mid, hi, mid, hi[~same]])
        a2 = np.concatenate([lo2, mid2, mid2, lo2[~same]])
        b2 = np.concatenate([mid2, hi2, hi2, mid2[~same]])
        e = np.concatenate([err, err, err + 1, err[~same] + 1]).astype(np.int8)
        keep = (e <= min(int(allowed[d + 1]), budget)) & (a < b) & (a2 < b2) & ~((a == a2) & (b - a < 2))
        stack.append((d + 1, a[keep], b[keep], a2[keep], b2[keep], e[keep]))


def links(group: np.ndarray, value: np.ndarray, ident: np.ndarray, bits: int, widths: list[int], label: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Edges (ident, ident) of a spanning forest of the links in each group of one rotation.

    The values of a group agree in their first block. Equal values are linked as well. Those of one label count
    as linked already: the forest spans labels.
    """
    order = np.lexsort((ident, value, group))
    group, value, ident, label = group[order], value[order], ident[order], np.unique(ident if label is None else label, return_inverse=True)[1][order]
    first = np.concatenate([[True], (group[1:] != group[:-1]) | (value[1:] != value[:-1])]) if len(value) else np.zeros(0, bool)
    leaf = np.cumsum(first) - 1
    head = ident[first][leaf] if len(value) else ident
    twin = ~first & (head != ident) & (label[first][leaf] != label)
    a, b = [head[twin]], [ident[twin]]
    g, v, i = group[first], value[first], ident[first]
    forest, allowed = Forest(np.unique(label[first], return_inverse=True)[1]), depth_budgets(widths)
    full = len(widths) - 1
    for budget in sorted({min(1, full), min(2, full), full} - {0}):  # near links first: they make dense groups collapse
        walk(g, v, bits, widths[0], allowed, budget, forest)
    for x, y in forest.edges:
        a.append(i[x])
        b.append(i[y])
    return np.concatenate(a), np.concatenate(b)
