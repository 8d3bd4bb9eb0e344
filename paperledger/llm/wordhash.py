"""64-bit hashes of the words of many texts at once, in numpy.

A word is a run of bytes other than ASCII white space; white space is ``[\\x20\\x09-\\x0D]``. A word's hash is a
polynomial over random values of its bytes, taken from running sums over slices of ``SLICE`` bytes, then mixed; beyond
the words' hashes and positions, memory does not grow with a text. Two words that differ share a hash with a chance
near 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 5
_M = (1 << 64) - 1
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _values(lower: bool) -> np.ndarray:
    v = np.random.default_rng(20_240_517).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    if lower:
        v[65:91] = v[97:123]
    v[[9, 10, 11, 12, 13, 32]] = 0
    return v


_VALUES = {x: _values(x) for x in (False, True)}
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes, words or tokens that are worked on at once: the size of all temporary arrays.
SLICE = 1 << 17
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.concatenate([np.ones(1, np.uint64), np.full(n - 1, base, np.uint64)]).cumprod(dtype=np.uint64)


_UP, _DOWN = _powers(_BASE, SLICE + 1), _powers(_INVERSE, SLICE + 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that scatters every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of the base and of its inverse, at least ``n`` of them."""
    return (_UP, _DOWN) if n <= len(_UP) else (_powers(_BASE, n), _powers(_INVERSE, n))


def power(n: int) -> np.uint64:
    return np.uint64(pow(_BASE, int(n), 1 << 64))


def chunks(texts: pa.Array, most: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of a string array of about ``most`` bytes: first row, end row, bytes, offsets from 0. Null is empty. A
    longer text is a slice of its own."""
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        b = min(b, n)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For the texts between the offsets: the words' hashes, and for n texts n+1 positions among these of each text's
    first word, and the words' first and end bytes. Bytes pass in slices; a word's sum goes on from one to the next."""
    none = np.empty(0, np.int64)
    hashes, begins, finishes = [np.empty(0, np.uint64)], [none], [none]
    inside_before, open_sum, open_start = False, 0, -1
    for s in range(0, len(data), SLICE):
        part = data[s : s + SLICE]
        n = len(part)
        inside = ~_SPACE[part]
        edge = np.zeros(n + 1, bool)
        edge[offsets[np.searchsorted(offsets, s) : np.searchsorted(offsets, s + n, "right")] - s] = True
        before = np.empty(n, bool)
        before[0] = inside_before and not edge[0]
        before[1:] = inside[:-1] & ~edge[1:-1]
        starts = np.flatnonzero(inside & ~before)
        after = np.empty(n, bool)
        after[:-1] = inside[1:] & ~edge[1:-1]
        after[-1] = s + n < len(data) and not edge[n] and not _SPACE[data[s + n]]
        ends = np.flatnonzero(inside & ~after) + 1
        goes_on = open_start >= 0
        with np.errstate(over="ignore"):
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(_VALUES[lower][part] * _UP[:n], out=total[1:])
            if goes_on and not len(ends):
                open_sum = (open_sum + int(total[n]) * int(power(s - open_start))) & _M
            else:
                if goes_on:
                    first = np.uint64((open_sum + int(total[ends[0]]) * int(power(s - open_start))) & _M)
                    h, size = np.r_[first, np.empty(len(ends) - 1, np.uint64)], np.r_[s + ends[0] - open_start, np.empty(len(ends) - 1, np.int64)]
                    at = np.r_[open_start, s + starts[: len(ends) - 1]]
                else:
                    h, size, at = np.empty(len(ends), np.uint64), np.empty(len(ends), np.int64), s + starts[: len(ends)]
                own, done = starts[: len(ends) - goes_on], ends[int(goes_on) :]
                h[int(goes_on) :] = (total[done] - total[own]) * _DOWN[own]
                size[int(goes_on) :] = done - own
                hashes.append(mix(h + size.astype(np.uint64) * GOLDEN))
                begins.append(at)
                finishes.append(s + ends)
                open_start = -1
                if len(starts) > len(own):
                    open_start = s + int(starts[-1])
                    open_sum = int((total[n] - total[starts[-1]]) * _DOWN[starts[-1]])
        inside_before = bool(inside[-1])
    starts = np.concatenate(begins)
    return np.concatenate(hashes), np.searchsorted(starts, offsets), starts, np.concatenate(finishes)


def shingles(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``n`` words within each text, in order, and the positions of each text's first. A text of
    fewer words, if any, has the whole sequence as its one shingle."""
    counts = np.diff(first)
    out = np.zeros(max(len(h) - n + 1, 0), np.uint64)
    with np.errstate(over="ignore"):
        for s in range(0, len(out), SLICE):
            own = out[s : s + SLICE]
            for j in range(n):
                own[:] = mix(own * GOLDEN + h[s + j : s + j + len(own)])
    if len(counts) == 1 and counts[0] >= n:
        return out, np.array([0, len(out)])
    have = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    at = np.zeros(len(first), np.int64)
    np.cumsum(have, out=at[1:])
    rows = np.repeat(np.arange(len(counts)), have)
    where = first[:-1][rows] + np.arange(at[-1]) - at[rows]
    whole = counts[rows] >= n
    got = np.zeros(at[-1], np.uint64)
    got[whole] = out[where[whole]]
    with np.errstate(over="ignore"):
        for k in np.flatnonzero(~whole):
            x = np.full(1, counts[rows[k]], np.uint64)
            for w in h[first[rows[k]] : first[rows[k] + 1]]:
                x = mix(x * GOLDEN + w)
            got[k] = mix(x ^ GOLDEN)[0]
    return got, at
