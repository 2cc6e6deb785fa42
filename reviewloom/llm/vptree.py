"""Vantage-point trees over 64-bit fingerprints: all pairs within a few differing bits.

In 64 random bits almost all distances lie near 32, where a tree over the whole fingerprint
prunes little. So there is one tree per *field* of bits: of two fingerprints that differ in
at most ``most`` bits, at least one of ``fields`` fields differs in at most
``most // fields``. Each tree divides by the distance, within its field, to vantage points.
The triangle bound with that small radius says which branches a fingerprint has to visit: it
lives in one leaf, its home, and queries the few leaves whose border it overlaps.

The upper tree is fitted on a bounded sample and only decides where rows go; leaves are
shards of a Spark shuffle, and inside a shard the division goes on. Pairs are verified on
all 64 bits, so the result is exact whatever the sample was.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

# Below this many homes a branch is compared directly, in blocks of at most so many pairs.
LEAF = 128
BLOCK = 1 << 21


def field_masks(fields: int) -> list[np.uint64]:
    edges = [64 * i // fields for i in range(fields + 1)]
    return [np.uint64((1 << b) - (1 << a)) for a, b in zip(edges, edges[1:], strict=False)]


def distance(points: np.ndarray, vantage: np.uint64, mask: np.uint64) -> np.ndarray:
    return np.bitwise_count((points ^ vantage) & mask).astype(np.int16)


@dataclass
class Tree:
    """A complete binary tree: node i has its children at 2i + 1 and 2i + 2."""

    mask: np.uint64
    vantage: np.ndarray
    border: np.ndarray
    depth: int


def _split(points: np.ndarray, mask: np.uint64, pick: int) -> tuple[np.uint64, int]:
    """A vantage point and the largest distance of the inner half."""
    vantage = points[pick % len(points)]
    found = np.sort(distance(points, vantage, mask))
    return vantage, int(found[(len(found) - 1) // 2])


def fit(sample: np.ndarray, mask: np.uint64, depth: int) -> Tree:
    size = 2**depth - 1
    tree = Tree(mask, np.zeros(size, np.uint64), np.zeros(size, np.int16), depth)
    parts: dict[int, np.ndarray] = {0: sample}
    for node in range(size):
        part = parts.pop(node)
        if len(part):
            tree.vantage[node], tree.border[node] = _split(part, mask, len(part) // 2)
        inner = distance(part, tree.vantage[node], mask) <= tree.border[node]
        parts[2 * node + 1], parts[2 * node + 2] = part[inner], part[~inner]
    return tree


def route(tree: Tree, points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of (index of a point, leaf, is it the point's home)."""
    index = np.arange(len(points))
    node = np.zeros(len(points), np.int64)
    home = np.ones(len(points), bool)
    for _ in range(tree.depth):
        far = np.bitwise_count((points[index] ^ tree.vantage[node]) & tree.mask).astype(np.int16)
        border = tree.border[node]
        inside = far <= border
        inner, outer = far <= border + radius, far > border - radius
        index = np.concatenate([index[inner], index[outer]])
        home = np.concatenate([(home & inside)[inner], (home & ~inside)[outer]])
        node = np.concatenate([2 * node[inner] + 1, 2 * node[outer] + 2])
    return index, node - (2**tree.depth - 1), home


class Groups:
    """Union of indices, vectorised; the smallest index of a group is its root."""

    def __init__(self, size: int):
        self.parent = np.arange(size)

    def find(self, index: np.ndarray) -> np.ndarray:
        root = self.parent[index]
        while True:
            up = self.parent[root]
            if np.array_equal(up, root):
                return root
            root = up

    def union(self, left: np.ndarray, right: np.ndarray) -> None:
        while len(left):
            a, b = self.find(left), self.find(right)
            apart = a != b
            left, right, a, b = left[apart], right[apart], a[apart], b[apart]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))

    def roots(self) -> np.ndarray:
        return self.find(np.arange(len(self.parent)))


def link(points: np.ndarray, home: np.ndarray, mask: np.uint64, radius: int, most: int) -> np.ndarray:
    """For each point the index of the root of its group, by links from any point to a home.

    The tree goes on inside the shard. No pair is kept beyond its block.
    """
    groups = Groups(len(points))
    stack = [(np.flatnonzero(home), np.arange(len(points)), 0)]
    while stack:
        inside, asking, tries = stack.pop()
        if not len(inside) or not len(asking):
            continue
        if len(inside) <= LEAF or tries == 3:
            step = max(1, BLOCK // len(inside))
            for at in range(0, len(asking), step):
                some = asking[at : at + step]
                near = np.bitwise_count(points[some, None] ^ points[None, inside]) <= most
                row, column = np.nonzero(near)
                groups.union(some[row], inside[column])
            continue
        vantage, border = _split(points[inside], mask, len(inside) // 2 + tries)
        far = distance(points[inside], vantage, mask)
        if far.max() <= border:
            stack.append((inside, asking, tries + 1))
            continue
        ask = distance(points[asking], vantage, mask)
        stack.append((inside[far <= border], asking[ask <= border + radius], 0))
        stack.append((inside[far > border], asking[ask > border - radius], 0))
    return groups.roots()
