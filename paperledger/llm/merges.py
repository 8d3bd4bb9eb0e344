"""Byte-pair merges of many words' parts at once, in numpy: the ids that a tokenizers file's BPE model gives.

Each part starts as its bytes. Again and again the pair of the lowest rank, the leftmost of equal ones, becomes one token,
in all parts of a group side by side, until no pair of a part has a rank. That is the model's own order: it keeps pairs
in a heap by rank and position. A round merges one pair of each part, so a part of n bytes takes n - 1 rounds at most.
"""

from __future__ import annotations

import numpy as np

#: Parts of these many bytes, the lower bound left out, are one group. A longer part is not for this module.
GROUPS = (0, 1, 3, 5, 8, 12, 18, 28, 64)
LONGEST = GROUPS[-1]
_ROWS = 1 << 13
_NONE = np.int32((1 << 31) - 1)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def byte_signs() -> list[str]:
    """The sign that stands for each byte in files of byte-level tokenizers."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Merges:
    """The merges of a file's BPE model; ``of`` tells whether a model is of a kind that this class follows exactly."""

    @staticmethod
    def of(model: dict) -> Merges | None:
        plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
        end = model.get("end_of_word_suffix") or ""
        if not plain or not all(c in model["vocab"] and c + end in model["vocab"] for c in byte_signs()):
            return None
        return Merges(model["vocab"], model["merges"], end)

    def __init__(self, vocab: dict[str, int], merges: list, end: str):
        self.first = np.array([vocab[c] for c in byte_signs()], np.int32)
        self.last = np.array([vocab[c + end] for c in byte_signs()], np.int32)
        self.none = max(vocab.values()) + 1  # of a place behind a part's end
        ranks = {}
        for rank, (a, b) in enumerate(m.split(" ") if isinstance(m, str) else m for m in merges):
            ranks[vocab[a] * (self.none + 1) + vocab[b]] = rank, vocab[a + b]
        keys = np.fromiter(ranks, np.int64, len(ranks))
        rank, made = (np.fromiter((x[i] for x in ranks.values()), np.int32, len(ranks)) for i in (0, 1))
        self.made = np.zeros(len(merges), np.int32)
        self.made[rank] = made
        bits = max(4 * len(keys), 16).bit_length()
        self.shift, self.keys, self.ranks = np.uint64(64 - bits), np.full(1 << bits, -1, np.int64), np.full(1 << bits, _NONE)
        at, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = self.keys[at[todo]] < 0
            self.keys[at[todo[free]]] = keys[todo[free]]
            won = self.keys[at[todo]] == keys[todo]
            self.ranks[at[todo[won]]] = rank[todo[won]]
            todo = todo[~won]
            at[todo] = self._next(at[todo])

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _GOLDEN) >> self.shift).astype(np.int64)

    def _next(self, at: np.ndarray) -> np.ndarray:
        return (at + 1) & (len(self.keys) - 1)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a.ravel().astype(np.int64) * (self.none + 1) + b.ravel()
        at = self._slot(keys)
        own = self.keys[at]
        out = np.where(own == keys, self.ranks[at], _NONE)
        open_ = np.flatnonzero((own != keys) & (own >= 0))
        while len(open_):
            at[open_] = self._next(at[open_])
            own = self.keys[at[open_]]
            hit = own == keys[open_]
            out[open_[hit]] = self.ranks[at[open_[hit]]]
            open_ = open_[~hit & (own >= 0)]
        return out.reshape(a.shape)

    def _group(self, data: np.ndarray, starts: np.ndarray, size: np.ndarray, rows: np.ndarray, done: list) -> None:
        """Merge these parts; to ``done`` go rows of parts that are through, their ids and how many of these count."""
        cols = np.arange(size.max())
        ids = self.first[data[np.minimum(starts[:, None] + cols, len(data) - 1)]]
        ids[np.arange(len(rows)), size - 1] = self.last[data[starts + size - 1]]
        ids[cols >= size[:, None]] = self.none
        ranks = self._rank(ids[:, :-1], ids[:, 1:])
        while ids.shape[1] > 1:
            at = ranks.argmin(1)
            rank = ranks[np.arange(len(rows)), at]
            go = rank != _NONE
            if not go.all():
                done.append((rows[~go], ids[~go], size[~go]))
                rows, ids, ranks, size, at, rank = (x[go] for x in (rows, ids, ranks, size, at, rank))
                if not len(rows):
                    return
            every, width = np.arange(len(rows)), ids.shape[1] - 1
            ids = np.where(cols[:width] <= at[:, None], ids[:, :-1], ids[:, 1:])
            ids[every, at] = self.made[rank]
            ranks = np.where(cols[: width - 1] < at[:, None], ranks[:, :-1], ranks[:, 1:])
            size = size - 1
            before, after = np.flatnonzero(at > 0), np.flatnonzero(at < width - 1)
            row, col = np.concatenate([every[before], every[after]]), np.concatenate([at[before] - 1, at[after]])
            ranks[row, col] = self._rank(ids[row, col], ids[row, col + 1])
        done.append((rows, ids, size))

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the parts between these offsets of bytes, and how many each has."""
        sizes, done = np.diff(offsets), []
        for low, high in zip(GROUPS, GROUPS[1:], strict=False):
            group = np.flatnonzero((sizes > low) & (sizes <= high))
            for a in range(0, len(group), _ROWS):
                rows = group[a : a + _ROWS]
                self._group(data, offsets[rows], sizes[rows], rows, done)
        count = np.zeros(len(sizes), np.int64)
        for rows, _, size in done:
            count[rows] = size
        upto = np.cumsum(count) - count
        flat = np.empty(count.sum(), np.uint32)
        for rows, ids, size in done:
            cols = np.arange(ids.shape[1])
            own = cols < size[:, None]
            flat[(upto[rows][:, None] + cols)[own]] = ids[own]
        return flat, count
