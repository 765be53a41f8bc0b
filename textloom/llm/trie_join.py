"""Self-join of 64-bit fingerprints by Hamming distance over a binary trie.

Sorted fingerprints are a binary trie: a node is a range of them, path-compressed to the bits its range has
in common. Node pairs are traversed together, level by level and in bulk; a pair is pruned when the bits
that its two prefixes differ in exceed the budget, or when all fingerprints below both are linked already.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np

LEAF = 16
_PAIRS = 1 << 18
_LEAF_PAIRS = 1 << 12
_MASK = np.array([(0xFFFFFFFFFFFFFFFF << (64 - d)) & 0xFFFFFFFFFFFFFFFF for d in range(65)], np.uint64)


class Trie:
    """Path-compressed binary trie over sorted distinct uint64 ``values``."""

    def __init__(self, values: np.ndarray):
        flat = values.tolist()
        lo, hi, depth, left = [0], [len(flat)], [0], [-1]
        k = 0
        while k < len(lo):
            a, b = lo[k], hi[k]
            differ = flat[a] ^ flat[b - 1]
            depth[k] = 64 - differ.bit_length()
            if b - a > LEAF:
                top = 1 << (differ.bit_length() - 1)
                mid = bisect_left(flat, flat[b - 1] & ~(top - 1), a, b)
                left[k] = len(lo)
                lo += [a, mid]
                hi += [mid, b]
                depth += [0, 0]
                left += [-1, -1]
            k += 1
        self.values = values
        self.lo, self.hi, self.depth, self.left = np.array(lo), np.array(hi), np.array(depth), np.array(left)
        self.first = values[self.lo]

    def uniform(self, labels: np.ndarray) -> np.ndarray:
        """The label of each node whose fingerprints share one, else -1."""
        out = np.full(len(self.lo), -1)
        leaves = np.flatnonzero(self.left < 0)
        leaves = leaves[np.argsort(self.lo[leaves])]
        starts = self.lo[leaves]
        least, most = np.minimum.reduceat(labels, starts), np.maximum.reduceat(labels, starts)
        out[leaves] = np.where(least == most, least, -1)
        for k in range(len(self.lo) - 1, -1, -1):
            if (c := self.left[k]) >= 0 and out[c] == out[c + 1]:
                out[k] = out[c]
        return out


def _merge(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give linked labels their least member's label, in place."""
    pairs = np.unique(np.stack([a, b], 1), axis=0).tolist()
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[y]
        return x

    for x, y in pairs:
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    old = np.array(sorted(parent))
    new = np.array([root(x) for x in old.tolist()])
    at = np.minimum(np.searchsorted(old, labels), len(old) - 1)
    hit = old[at] == labels
    labels[hit] = new[at[hit]]


def _visit(s: Trie, t: Trie, labels: np.ndarray, shift: int, budget: int) -> None:
    """Traverse node pairs of ``s`` and ``t`` (the same trie if shift is 0), merging labels of linked fingerprints."""
    same = shift == 0
    us, ut = s.uniform(labels[: len(s.values)]), t.uniform(labels[shift : shift + len(t.values)])
    stack = [(np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        a, b = stack.pop()
        if len(a) > _PAIRS:
            half = len(a) // 2
            stack += [(a[:half], b[:half]), (a[half:], b[half:])]
            continue
        errors = np.bitwise_count((s.first[a] ^ t.first[b]) & _MASK[np.minimum(s.depth[a], t.depth[b])])
        keep = (errors <= budget) & ((us[a] < 0) | (us[a] != ut[b]))
        a, b = a[keep], b[keep]
        if not len(a):
            continue
        la, lb = s.left[a] < 0, t.left[b] < 0
        done = la & lb
        for k in range(0, int(done.sum()), _LEAF_PAIRS):
            _leaves(s, t, a[done][k : k + _LEAF_PAIRS], b[done][k : k + _LEAF_PAIRS], labels, shift, budget)
        own = ~done & (a == b) if same else np.zeros(len(a), bool)
        split_a = ~done & ~own & ~la & (lb | (s.hi[a] - s.lo[a] >= t.hi[b] - t.lo[b]))
        split_b = ~done & ~own & ~split_a
        ca, cb, co = s.left[a[split_a]], t.left[b[split_b]], s.left[a[own]]
        stack.append((np.concatenate([ca, ca + 1, a[split_b], a[split_b], co, co, co + 1]), np.concatenate([b[split_a], b[split_a], cb, cb + 1, co, co + 1, co + 1])))


def _leaves(s: Trie, t: Trie, a: np.ndarray, b: np.ndarray, labels: np.ndarray, shift: int, budget: int) -> None:
    steps = np.arange(LEAF)
    ia, ib = s.lo[a][:, None] + steps, t.lo[b][:, None] + steps
    there = (ia < s.hi[a][:, None])[:, :, None] & (ib < t.hi[b][:, None])[:, None, :]
    ia, ib = np.minimum(ia, len(s.values) - 1), np.minimum(ib, len(t.values) - 1)
    near = np.bitwise_count(s.values[ia][:, :, None] ^ t.values[ib][:, None, :]) <= budget
    k, i, j = np.nonzero(near & there)
    x, y = labels[ia[k, i]], labels[shift + ib[k, j]]
    new = x != y
    if new.any():
        _merge(labels, x[new], y[new])


def trie_links(left: np.ndarray, right: np.ndarray | None, budget: int) -> np.ndarray:
    """Group fingerprints that differ in ``budget`` bits or fewer, directly or in a chain.

    ``left`` and ``right`` are sorted distinct uint64 arrays, with no value in both; without ``right``, left
    is joined with itself, else pairs with one fingerprint on each side are. Returns a label for each of
    left, then right: the least position of its group.
    """
    n = len(left)
    labels = np.arange(n + (0 if right is None else len(right)))
    if not n or right is not None and not len(right):
        return labels
    s = Trie(left)
    t = s if right is None else Trie(right)
    # Small budgets first: the groups they find let the full budget skip pairs inside a group.
    for budget_now in sorted({min(1, budget), min(2, budget), budget}):
        _visit(s, t, labels, 0 if right is None else n, budget_now)
    return labels
