"""A signature tree over sets of 64-bit tokens, and its join with itself or another tree.

A leaf entry has a bitmap of its tokens' hashes; a node has the OR of its children's
bitmaps, the range of their sizes and the largest number of tokens that share a bit.
Two nodes can hold a linked pair only if bits in common plus shared-bit tokens reach
the overlap that the smallest sizes ask for; the dual traversal drops all others.
"""

import numpy as np

from .textops import slices

FANOUT = 16
SLICE_TOKENS = 1 << 16
# Of all bitmaps of a block. One large set among many small ones would ask for many times the sets' own size.
MAP_BYTES = 32 << 20


class Union:
    """Disjoint sets over positions; the least position names a set."""

    def __init__(self, labels: np.ndarray):
        _, first, inverse = np.unique(labels, return_index=True, return_inverse=True)
        self.parent = first[inverse]

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return int(i)

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.parent[max(i, j)] = min(i, j)

    def all(self) -> np.ndarray:
        while True:
            up = self.parent[self.parent]
            if (up == self.parent).all():
                return up
            self.parent = up


def needed(a, b, num: int, den: int):
    """Least overlap of sets of sizes a and b at similarity ``num / den``: rounded up."""
    return -((-(a + b) * num) // (num + den))


def signatures(tokens: np.ndarray, bounds: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(bitmaps as words of 64 bits, tokens beyond the first on their bit) of each set."""
    n = len(bounds) - 1
    flat = np.zeros(n * bits // 8, np.uint8)
    for i, j in slices(bounds, SLICE_TOKENS):
        owner = np.repeat(np.arange(i, j), np.diff(bounds[i : j + 1]))
        bit = (tokens[bounds[i] : bounds[j]] & np.uint64(bits - 1)).astype(np.int64)
        np.bitwise_or.at(flat, owner * (bits // 8) + (bit >> 3), (1 << (bit & 7)).astype(np.uint8))
    maps = flat.view(np.uint64).reshape(n, bits // 64)
    used = np.bitwise_count(maps).sum(axis=1, dtype=np.int64)
    return maps, np.diff(bounds) - used


class Tree:
    """Levels from the leaves (one set each, in order of size) up to one root."""

    def __init__(self, maps: np.ndarray, extra: np.ndarray, sizes: np.ndarray, order: np.ndarray):
        self.order = order
        level = (maps[order], extra[order], sizes[order], sizes[order])
        self.levels = [level]
        while len(level[1]) > 1:
            starts = np.arange(0, len(level[1]), FANOUT)
            level = (
                np.bitwise_or.reduceat(level[0], starts, axis=0),
                np.maximum.reduceat(level[1], starts),
                np.minimum.reduceat(level[2], starts),
                np.maximum.reduceat(level[3], starts),
            )
            self.levels.append(level)


def _possible(x, y, i: np.ndarray, j: np.ndarray, num: int, den: int, step: int = 4096) -> np.ndarray:
    """Which node pairs (i of level x, j of level y) may hold a linked pair."""
    out = np.empty(len(i), bool)
    for a in range(0, len(i), step):
        p, q = i[a : a + step], j[a : a + step]
        common = np.bitwise_count(x[0][p] & y[0][q]).sum(axis=1, dtype=np.int64)
        most = np.minimum(common + np.minimum(x[1][p], y[1][q]), np.minimum(x[3][p], y[3][q]))
        near = (x[2][p] * num <= y[3][q] * den) & (y[2][q] * num <= x[3][p] * den)
        out[a : a + step] = near & (most >= needed(x[2][p], y[2][q], num, den))
    return out


def links(
    tokens: np.ndarray,
    bounds: np.ndarray,
    labels: np.ndarray,
    side: np.ndarray | None,
    num: int,
    den: int,
    bits_a_token: int = 16,
    most_bits: int = 1 << 16,
) -> list[tuple[int, int]]:
    """Verified links that connect what the sets' links connect, as pairs of positions.

    ``labels`` tells which sets are known to be connected already: such pairs are not
    looked at again. ``side`` (0 or 1) restricts the join to pairs across; None joins
    all with all. Every pair of different labels is either dropped by a bound or
    compared token by token.
    """
    n = len(bounds) - 1
    sizes = np.diff(bounds)
    bits = 64
    while bits < min(most_bits, bits_a_token * int(sizes.max(initial=1))) and n * bits // 4 <= MAP_BYTES:
        bits *= 2
    maps, extra = signatures(tokens, bounds, bits)
    known, found = Union(labels), []
    groups = [np.arange(n)] if side is None else [np.flatnonzero(side == 0), np.flatnonzero(side == 1)]
    trees = [Tree(maps, extra, sizes, g[np.lexsort((g, sizes[g]))]) for g in groups if len(g)]
    if len(trees) < len(groups):
        return []
    left, right = trees[0], trees[-1]

    def verify(i: np.ndarray, j: np.ndarray) -> None:
        a, b = left.order[i], right.order[j]
        while len(a):
            now = known.all()
            open_ = now[a] != now[b]
            a, b = a[open_], b[open_]
            for x, y in zip(a[:32].tolist(), b[:32].tolist()):
                if known.find(x) == known.find(y):
                    continue
                own, other = tokens[bounds[x] : bounds[x + 1]], tokens[bounds[y] : bounds[y + 1]]
                if len(own) > len(other):
                    own, other = other, own
                at = np.searchsorted(other, own)
                both = int((other[np.minimum(at, len(other) - 1)] == own).sum())
                if both * (num + den) >= num * (len(own) + len(other)):
                    known.join(x, y)
                    found.append((x, y))
            a, b = a[32:], b[32:]

    def descend(i: np.ndarray, j: np.ndarray, li: int, lj: int) -> None:
        """Traverse node pairs of levels li and lj, in blocks so that the frontier stays small."""
        if left is right:
            i, j = i[i <= j], j[i <= j]
        if li == 0 and lj == 0:
            now = known.all()
            open_ = now[left.order[i]] != now[right.order[j]]
            i, j = i[open_], j[open_]
        keep = _possible(left.levels[li], right.levels[lj], i, j, num, den)
        i, j = i[keep], j[keep]
        if li == 0 and lj == 0:
            verify(i, j)
            return
        for a in range(0, len(i), 256):
            p, q = i[a : a + 256], j[a : a + 256]
            down_i, down_j = li > 0, lj > 0
            kids_i = p[:, None] * FANOUT + np.arange(FANOUT) if down_i else p[:, None]
            kids_j = q[:, None] * FANOUT + np.arange(FANOUT) if down_j else q[:, None]
            ni, nj = len(left.levels[li - down_i][1]), len(right.levels[lj - down_j][1])
            pi = np.repeat(kids_i[:, :, None], kids_j.shape[1], axis=2).ravel()
            pj = np.repeat(kids_j[:, None, :], kids_i.shape[1], axis=1).ravel()
            inside = (pi < ni) & (pj < nj)
            descend(pi[inside], pj[inside], li - down_i, lj - down_j)

    top = np.zeros(1, np.int64)
    descend(top, top, len(left.levels) - 1, len(right.levels) - 1)
    return found
