"""Trees of token bitmaps for similarity joins of sets.

A set's bitmap has one bit for each token's hash, 2 to 4 bits for each token. Nodes hold the OR of their members'
bitmaps, the least and largest set size, and the largest count of tokens that share a bit with another of their set.
For members x of node A and y of node B, each bit of x that B lacks is a token that y lacks, so

    |x & y| <= min(largest size of A, of B, loss of A + c, loss of B + c),   c = bits common to A and B.

A pair of nodes that can't reach the least overlap of its smallest sizes goes with all that is below it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

FANOUT = 8
STEP = 4096


def width(n: int) -> int:
    """Bytes of the bitmap of a set of ``n`` tokens."""
    return max(8, 1 << max(0, (2 * int(n) - 1).bit_length() - 3))


def bitmap(tokens: np.ndarray, size: int | None = None) -> np.ndarray:
    """Bits are the low bits of the token, so that folding halves a bitmap."""
    size = size or width(len(tokens))
    bits = np.zeros(size * 8, bool)
    bits[(tokens & np.uint64(size * 8 - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little")


def fold(rows: np.ndarray, size: int) -> np.ndarray:
    while rows.shape[1] > size:
        half = rows.shape[1] // 2
        rows = rows[:, :half] | rows[:, half:]
    return rows


def _count(words: np.ndarray) -> np.ndarray:
    return np.bitwise_count(words).sum(-1, dtype=np.int64)


class Tree:
    """Levels from the leaves, which are the members in the order of their bitmaps, up to at most FANOUT nodes."""

    def __init__(self, rows: np.ndarray, sizes: np.ndarray, ids: np.ndarray):
        words = np.ascontiguousarray(rows).view(np.uint64)
        order = np.lexsort(words.T[: min(4, words.shape[1])][::-1])
        self.ids = ids[order]
        words, sizes = words[order], sizes[order].astype(np.int64)
        self.words, self.low, self.high, self.loss = [words], [sizes], [sizes], [sizes - _count(words)]
        while len(self.words[-1]) > FANOUT:
            at = np.arange(0, len(self.words[-1]), FANOUT)
            self.words.append(np.bitwise_or.reduceat(self.words[-1], at))
            self.low.append(np.minimum.reduceat(self.low[-1], at))
            self.high.append(np.maximum.reduceat(self.high[-1], at))
            self.loss.append(np.maximum.reduceat(self.loss[-1], at))

    def sink(self, level: int) -> None:
        """Add single-child levels at the top until there are ``level`` + 1."""
        while len(self.words) <= level:
            for x in (self.words, self.low, self.high, self.loss):
                x.append(x[-1])

    def children(self, level: int, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First child and end, at the level below."""
        if len(self.words[level]) == len(self.words[level - 1]):
            return node, node + 1
        return node * FANOUT, np.minimum(node * FANOUT + FANOUT, len(self.words[level - 1]))


def _expand(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    na, nb = a[1] - a[0], b[1] - b[0]
    n = na * nb
    rows = np.repeat(np.arange(len(n)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return a[0][rows] + k // nb[rows], b[0][rows] + k % nb[rows]


def pairs(x: Tree, y: Tree, of: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidate pairs of members, by their ids, each once; if x is y, the tree is joined with itself. Where ``of``
    gives a label for each id, which the caller may change between steps, pairs of one label are left out, and so are
    node pairs all of whose members have it. Depth first, some thousand node pairs at a time."""
    same = x is y
    top = max(len(x.words), len(y.words)) - 1
    x.sink(top)
    y.sink(top)
    ia, ib = _expand((np.zeros(1, np.int64), np.array([len(x.words[top])])), (np.zeros(1, np.int64), np.array([len(y.words[top])])))
    if same:
        ia, ib = ia[ia <= ib], ib[ia <= ib]
    stack = [(top, ia, ib)]
    while stack:
        level, ia, ib = stack.pop()
        if len(ia) > STEP:
            stack.append((level, ia[STEP:], ib[STEP:]))
            ia, ib = ia[:STEP], ib[:STEP]
        c = _count(x.words[level][ia] & y.words[level][ib])
        most = np.minimum(np.minimum(x.high[level][ia], y.high[level][ib]), np.minimum(x.loss[level][ia], y.loss[level][ib]) + c)
        keep = 9 * most >= 4 * (x.low[level][ia] + y.low[level][ib])
        if same and level == 0:
            keep &= ia < ib
        ia, ib = ia[keep], ib[keep]
        if of is not None and len(ia) and level < 2:
            if level == 0:
                apart = of[x.ids[ia]] != of[y.ids[ib]]
            else:
                (lo, hi), (lo2, hi2) = _spans(x, of), _spans(y, of)
                apart = ~((lo[ia] == hi[ia]) & (lo2[ib] == hi2[ib]) & (lo[ia] == lo2[ib]))
            ia, ib = ia[apart], ib[apart]
        if not len(ia):
            continue
        if level == 0:
            yield x.ids[ia], y.ids[ib]
            continue
        ja, jb = _expand(x.children(level, ia), y.children(level, ib))
        if same:
            ja, jb = ja[ja <= jb], jb[ja <= jb]
        stack.append((level - 1, ja, jb))


def _spans(t: Tree, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest label below each node of level 1."""
    labels = of[t.ids]
    if len(t.words[1]) == len(labels):
        return labels, labels
    at = np.arange(0, len(labels), FANOUT)
    return np.minimum.reduceat(labels, at), np.maximum.reduceat(labels, at)


class Labels:
    """Which of n members are joined, and the edges that joined them: a forest. ``of`` is each member's root."""

    def __init__(self, n: int):
        self.of = np.arange(n)
        self.edges: list[tuple[int, int]] = []

    def _root(self, i: int) -> int:
        of = self.of
        while of[i] != i:
            of[i] = of[of[i]]
            i = of[i]
        return int(i)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        apart = self.of[a] != self.of[b]
        a, b = a[apart], b[apart]
        if not len(a):
            return
        ra, rb = self.of[a], self.of[b]
        key = np.minimum(ra, rb) * len(self.of) + np.maximum(ra, rb)
        for i in np.unique(key, return_index=True)[1]:
            p, q = self._root(a[i]), self._root(b[i])
            if p != q:
                self.of[max(p, q)] = min(p, q)
                self.edges.append((int(a[i]), int(b[i])))
        while (up := self.of[self.of]).tobytes() != self.of.tobytes():
            self.of[:] = up
