"""Word-shingle sets, their count vectors, and an R-tree over count vectors.

A set's elements are hashed into groups by their leading bits; the counts of
the groups are a point.  Two sets can't share more elements than the sum, over
the groups, of the smaller count, and no set inside a box can share more than
the sum of the smaller of its own count and the box's upper corner.  ``Tree``
packs points into leaves and boxes and passes over every box whose bound is
too small.  What is left is verified on the sets themselves by the caller.
"""

from __future__ import annotations

import numpy as np

from barline.llm import wordhash

LEAF = 16


def shingles(rows: np.ndarray, words: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(row, 63-bit hash) of each run of ``size`` words; a row with fewer words
    has one run of all its words.  Not yet distinct."""
    if len(rows) == 0:
        return rows, words
    first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    count = np.diff(np.r_[first, len(rows)])
    out_rows, out_hash = [], []
    for k in range(1, size + 1):  # k words: rows with just k of them, or more if k is `size`
        if k == size:
            at = np.arange(len(rows) - size + 1) if len(rows) >= size else np.zeros(0, dtype=np.int64)
            at = at[rows[at] == rows[at + size - 1]]
        else:
            at = first[count == k]
        h = wordhash.mix(words[at], 20 + k)
        for j in range(1, k):
            h = wordhash.mix(h * np.uint64(3) + words[at + j], 30 + j)
        out_rows.append(rows[at])
        out_hash.append(h >> np.uint64(1))
    return np.concatenate(out_rows), np.concatenate(out_hash)


def distinct(rows: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted by row, then key, each pair once."""
    order = np.argsort(keys, kind="stable")
    order = order[np.argsort(rows[order].astype(np.int32), kind="stable")]
    rows, keys = rows[order], keys[order]
    new = np.r_[True, (rows[1:] != rows[:-1]) | (keys[1:] != keys[:-1])] if len(rows) else np.zeros(0, dtype=bool)
    return rows[new], keys[new]


def similar(common: int, a: int, b: int) -> bool:
    """Jaccard similarity of 0.75 or more, in whole numbers."""
    return 7 * common >= 3 * (a + b)


def group_bits(n: int) -> int:
    """log2 of the number of groups for a set of n elements: two to four elements a group."""
    return int(min(max(int(n).bit_length() - 2, 4), 12))


def count_vector(keys: np.ndarray, bits: int) -> np.ndarray:
    return np.bincount((keys >> np.uint64(63 - bits)).astype(np.int64), minlength=1 << bits).astype(np.uint16)


def pack_vector(v: np.ndarray) -> bytes:
    return v.astype(np.uint8).tobytes() if v.max(initial=0) < 256 else v.tobytes()


def unpack_vector(data: bytes, n: int) -> np.ndarray:
    kind = np.uint8 if len(data) == 1 << group_bits(n) else np.uint16
    return np.frombuffer(data, dtype=kind).astype(np.uint16)


def fold(v: np.ndarray, bits: int) -> np.ndarray:
    return v.reshape(1 << bits, -1).sum(axis=1, dtype=np.uint16)


class Tree:
    """A packed R-tree of points of one dimension count."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        order, stack = [], [np.arange(len(points))]
        while stack:  # halve along the coordinate, or the size, that spreads most
            part = stack.pop()
            if len(part) <= LEAF:
                order.append(part)
                continue
            x = points[part].astype(np.int32)
            spread = x.var(axis=0)
            axis = int(spread.argmax())
            values = sizes[part] if sizes[part].std() > 4 * np.sqrt(spread[axis]) else x[:, axis]
            part = part[np.argsort(values, kind="stable")]
            stack += [part[len(part) // 2 :], part[: len(part) // 2]]
        self.order = np.concatenate(order) if order else np.zeros(0, dtype=np.int64)
        ends = np.cumsum([len(p) for p in order]) if order else np.zeros(0, dtype=np.int64)
        self.starts = np.r_[0, ends[:-1]].astype(np.int64) if order else ends
        self.points, self.sizes = points[self.order], sizes[self.order]
        self.many = len(order) > 1
        if self.many:
            self.upper = np.maximum.reduceat(self.points, self.starts, axis=0)
            self.least = np.minimum.reduceat(self.sizes, self.starts)
            self.most = np.maximum.reduceat(self.sizes, self.starts)
            self.ends = ends

    def query(self, point: np.ndarray, n: int, open_: np.ndarray) -> np.ndarray:
        """Open points (numbers as given) whose bound allows similarity to ``point``."""
        if self.many:
            boxes = np.flatnonzero((4 * self.most >= 3 * n) & (3 * self.least <= 4 * n))
            bound = np.minimum(self.upper[boxes], point).sum(axis=1, dtype=np.int64)
            boxes = boxes[7 * bound >= 3 * (n + self.least[boxes])]
            if len(boxes) == 0:
                return boxes
            at = np.concatenate([np.arange(self.starts[b], self.ends[b]) for b in boxes])
            at = at[open_[self.order[at]]]
        else:
            at = np.flatnonzero(open_[self.order])
        bound = np.minimum(self.points[at], point).sum(axis=1, dtype=np.int64)
        return self.order[at[7 * bound >= 3 * (n + self.sizes[at])]]


class Group:
    """Sets of (mark, elements, root) that hubs are compared with, indexed by size class."""

    def __init__(self, rows: list[tuple[bytes, np.ndarray, bytes]]):
        self.rows = rows
        #: Roots that hubs have joined in this group.
        self.joined: dict[bytes, bytes] = {}
        sizes = np.array([len(s) for _, s, _ in rows], dtype=np.int64)
        self.trees = []
        for bits in sorted({group_bits(n) for n in sizes}):
            own = np.array([i for i, n in enumerate(sizes) if group_bits(n) == bits])
            points = np.stack([count_vector(rows[i][1], bits) for i in own])
            self.trees.append((bits, own, Tree(points, sizes[own])))

    def root(self, x: bytes) -> bytes:
        while x in self.joined:
            x = self.joined[x]
        return x

    def reach(self, elements: np.ndarray, root: bytes) -> list[bytes]:
        """Marks of sets similar to a hub: one of each component that isn't joined to it yet."""
        n, found = len(elements), []
        for bits, own, tree in self.trees:
            if 4 * tree.sizes.max() < 3 * n or 3 * tree.sizes.min() > 4 * n:
                continue
            point = count_vector(elements, bits)
            for k in own[tree.query(point, n, np.ones(len(own), dtype=bool))]:
                mark, other, theirs = self.rows[k]
                a, b = self.root(root), self.root(theirs)
                if a != b and similar(len(np.intersect1d(elements, other, assume_unique=True)), n, len(other)):
                    self.joined[b] = a
                    found.append(mark)
        return found


def links(vectors: list[np.ndarray], sizes: np.ndarray, check=None) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the points under ``check`` (by the bound alone, if None).

    From each point in turn, whatever is similar and not yet reached is
    reached, so a point is never compared with one it is already joined to.
    Points are indexed by size class, with the next smaller class's larger
    part, at that class's number of groups.
    """
    m = len(sizes)
    out: list[tuple[int, int]] = []
    if m == 2:  # most blocks
        bits = min(group_bits(sizes[0]), group_bits(sizes[1]))
        both = int(np.minimum(fold(vectors[0], bits), fold(vectors[1], bits)).sum())
        return [(0, 1)] if 7 * both >= 3 * int(sizes.sum()) and (check is None or check(0, 1)) else out
    classes = np.array([group_bits(n) for n in sizes])
    tops = np.array([int(n).bit_length() for n in sizes])
    trees = []
    for top in np.unique(tops):
        own = np.flatnonzero((tops == top) | (tops == top - 1) & (8 * sizes.astype(np.int64) >= 3 * (1 << int(top))))
        bits = int(classes[own].min())
        points = np.stack([fold(vectors[i], bits) for i in own])
        trees.append((own, np.searchsorted(own, np.arange(m)), points, Tree(points, sizes[own].astype(np.int64))))
    member = [[] for _ in range(m)]
    for t, (own, place, _, _) in enumerate(trees):
        for i in own:
            member[i].append((t, int(place[i])))
    open_ = np.ones(m, dtype=bool)
    for seed in range(m):
        if not open_[seed]:
            continue
        open_[seed] = False
        reach = [seed]
        while reach:
            q = reach.pop()
            for t, at in member[q]:
                own, _, points, tree = trees[t]
                for c in own[tree.query(points[at], int(sizes[q]), open_[own])]:
                    if open_[c] and (check is None or check(q, int(c))):
                        open_[c] = False
                        out.append((q, int(c)))
                        reach.append(int(c))
    return out
